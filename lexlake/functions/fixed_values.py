"""Values the results depend on."""

# ---- fixed values -------------------------------------------------------------------------------------------------

# parts of speech the definition service returns
PARTS_OF_SPEECH = (
    "noun",
    "verb",
    "adjective",
    "adverb",
    "pronoun",
    "determiner",
    "preposition",
    "number",
    "conjunction",
    "particle",
    "infinitive marker",
    "exclamation",
    "postposition",
    "article",
)

# translation-service tag -> the parts of speech it may stand for
TRANSLATION_TAGS = {
    "ADJ": ("adjective",),
    "ADV": ("adverb",),
    "CONJ": ("conjunction",),
    "DET": ("determiner", "article"),
    "MODAL": ("verb",),
    "NOUN": ("noun", "number"),
    "PREP": ("preposition", "particle", "infinitive marker", "postposition"),
    "PRON": ("pronoun",),
    "VERB": ("verb",),
    "OTHER": ("exclamation", "particle", "infinitive marker", "postposition"),
}

# part of speech -> tag understood by the usage service
USAGE_TAGS = {
    "noun": "NOUN",
    "verb": "VERB",
    "adjective": "ADJ",
    "adverb": "ADV",
    "pronoun": "PRON",
    "determiner": "DET",
    "preposition": "ADP",
    "number": "NUM",
    "conjunction": "CONJ",
    "particle": "PRT",
    "infinitive marker": "PRT",
    "exclamation": "PRT",
    "postposition": "ADP",
    "article": "DET",
}

USAGE_CORPUS = "eng_2019"
USAGE_FIRST_YEAR = 2015
USAGE_LAST_YEAR = 2019
USAGE_ENDPOINT = "https://books.google.com/ngrams/json"
DEFINITION_ENDPOINT = "https://api.dictionaryapi.dev/api/v2/entries/en"

# services' safe request rates per second, for a whole job; None is unlimited
DEFINITION_RPS = 1.49
TRANSLATION_RPS = None
USAGE_RPS = 0.48

# what a missing enrichment is filled with, by column type
MISSING_TEXT = "!ENRICHMENT NOT FOUND!"
MISSING_NUMBER = -1.0

# learning status of a published row
STATUS_NEW = "new"
STATUS_IN_PROGRESS = "in progress"
STATUS_LEARNED = "learned"

# rendering of published cells
CELL_SEPARATOR = "\n* "
CSV_CELL_SEPARATOR = ", "
WORKLIST_SEPARATOR = ", "
USAGE_DECIMALS = 6
SHEET_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# a mark is tagged with this number in the reader's database
MARK_TAG_ID = 104

# a highlight is cut at every character that is not a word character, a hyphen or white space
TOKEN_BREAK = r"[^\w\-\s]"

# ---- end of fixed values ------------------------------------------------------------------------------------------
