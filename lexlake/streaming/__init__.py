"""The batch jobs triggered by arriving marks."""
