"""The expected result of each query as SQL over the plain tables.

The SQL goes from the relational tables straight to the result; it neither builds nor parses the JSON the queries go
through. Shared steps are common table expressions put in front of the statements that need them.
"""

from __future__ import annotations

from lexlake.functions import fixed_values as fixed

SEP = "chr(10) || '* '"
DAY_1, DAY_2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def arr(expression: str) -> str:
    return f"array_to_string(list_sort({expression}), '|')"


def ts(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def tag_list(column: str) -> str:
    cases = " ".join(f"WHEN '{tag}' THEN '{','.join(parts)}'" for tag, parts in fixed.TRANSLATION_TAGS.items())
    return f"CASE {column} {cases} ELSE {column} END"


def usage_key(text: str, part: str) -> str:
    cases = " ".join(f"WHEN '{p}' THEN '_{tag}'" for p, tag in fixed.USAGE_TAGS.items())
    return f"{text} || (CASE {part} {cases} ELSE '' END) || ':{fixed.USAGE_CORPUS}'"


def url(expression: str) -> str:
    # form encoding: a blank is '+', '*' stays and '~' does not
    encoded = f"replace(url_encode({expression}), '%20', '+')"
    return f"replace(replace({encoded}, '%2A', '*'), '~', '%7E')"


# ---- highlights and tokens ----------------------------------------------------------------------------------------


def tokens_cte(name: str, source: str, text: str, book: str, seconds: str, strict: bool = False) -> str:
    """(text, book, seen) per token occurrence."""
    extra = " AND length(trim(lower(piece))) > 1" if strict else ""
    return f"""{name} AS (
      SELECT trim(lower(piece)) AS text, book, seen FROM (
        SELECT unnest(regexp_split_to_array({text}, '[^\\w\\-\\s]')) AS piece, {book} AS book,
               make_timestamp(({seconds}) * 1000000) AS seen
        FROM {source})
      WHERE length(piece) > 1{extra})"""


def document_tokens(strict: bool = False) -> str:
    return tokens_cte("tokens", "documents", "text", "'`' || source || '` BY `' || lang || '`'", "doc_id * 60", strict)


STATS = f"""SELECT text, {arr('list(DISTINCT book)')} AS books, count(*) AS occurrences,
  {ts('min(seen)')} AS "firstOccurrence", {ts('max(seen)')} AS "latestOccurrence" FROM tokens GROUP BY text"""

HIGHLIGHTS = """SELECT doc_id AS oid, text, source AS title, lang AS authors, doc_id * 60 AS "timeEdt"
  FROM documents WHERE lang <> 'de'"""

# ---- order tokens and their definitions ---------------------------------------------------------------------------

PART_OF_SPEECH = """CASE WHEN l_returnflag = 'A' THEN 'noun' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'verb'
  WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'adverb' END"""

LINES = f"""lines AS (
  SELECT *, 'order ' || o_orderkey AS text, 'customer ' || o_custkey AS word, {PART_OF_SPEECH} AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ORDER_TOKENS = """order_tokens AS (
  SELECT text, o_orderkey, list_sort(list(DISTINCT 'flag ' || l_returnflag)) AS books, count(*) AS n,
         min(l_shipdate) AS first, max(l_shipdate) AS latest, any_value(o_orderdate) AS u
  FROM lines GROUP BY text, o_orderkey)"""

# kind: 0 not found, 1 known without a meaning, 2 defined
DEFINED = """defined AS (
  SELECT text, CASE WHEN kind > 0 THEN word END AS word,
    CASE WHEN kind > 0 AND o_orderstatus <> 'P' THEN '/' || o_orderpriority || '/' END AS phonetic,
    CASE WHEN kind = 2 THEN pos END AS pos,
    CASE WHEN kind = 2 THEN 'part ' || (l_partkey % 40) END AS def,
    CASE WHEN kind = 2 THEN CASE WHEN l_linenumber % 2 = 1 THEN [strftime(l_shipdate, '%Y-%m-%d')]
         ELSE []::VARCHAR[] END END AS examples,
    CASE WHEN kind = 2 THEN [l_linestatus] END AS synonyms,
    CASE WHEN kind = 2 THEN []::VARCHAR[] END AS antonyms
  FROM (SELECT *, row_number() OVER (PARTITION BY text) AS rn,
          CASE WHEN o_orderpriority = '5-LOW' THEN 0
               WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 1 ELSE 2 END AS kind FROM lines)
  WHERE kind = 2 OR rn = 1)"""

SILVER = """silver AS (
  SELECT text, books, n, first, latest, u, word, phonetic, pos, def, examples, synonyms, antonyms FROM (
    SELECT d.*, t.books, t.n, t.first, t.latest, t.u, row_number() OVER (PARTITION BY d.text, word, def
      ORDER BY phonetic NULLS FIRST, pos NULLS FIRST, examples NULLS FIRST, synonyms NULLS FIRST) AS rn
    FROM defined d JOIN order_tokens t USING (text)) WHERE rn = 1)"""

RECORDS = """records AS (
  SELECT word, def, list_sort(list(DISTINCT text)) AS forms, sum(n)::BIGINT AS n, min(first) AS first,
    max(latest) AS latest, list_sort(list_distinct(flatten(list(books)))) AS books,
    arg_max({'phonetic': phonetic, 'pos': pos, 'examples': examples, 'synonyms': synonyms, 'antonyms': antonyms},
            {'u': u, 't': text}) AS a
  FROM silver WHERE word IS NOT NULL AND def IS NOT NULL GROUP BY word, def)"""

ORDER_SILVER = (LINES, ORDER_TOKENS, DEFINED, SILVER)
ORDER_RECORDS = (*ORDER_SILVER, RECORDS)

TRANSLATIONS = f"""lookups AS (
    SELECT 'customer ' || c_custkey AS word, c_name, c_acctbal, o.* FROM customer LEFT JOIN (
      SELECT o_custkey, 'target ' || (o_orderkey % 97) AS target,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'NOUN' WHEN '2-HIGH' THEN 'ADV' WHEN '3-MEDIUM' THEN 'VERB'
             WHEN '4-NOT SPECIFIED' THEN 'XYZ' END AS tag,
        CASE o_orderstatus WHEN 'F' THEN 'the' WHEN 'O' THEN '' END AS prefix
      FROM orders) o ON c_custkey = o.o_custkey),
  translations AS (
    SELECT word, c_name AS display, target, {tag_list('tag')} AS tags, prefix
    FROM lookups WHERE o_custkey IS NOT NULL AND c_acctbal >= 0
    UNION ALL
    SELECT DISTINCT word, CASE WHEN o_custkey IS NOT NULL THEN c_name END, NULL, NULL, NULL
    FROM lookups WHERE o_custkey IS NULL OR c_acctbal < 0)"""


def attach_ctes(records: str, translations: str, out: str, exact: bool = False) -> str:
    """CTE ``out``: (word, def, found, display) per row of ``records`` (word, def, pos)."""

    def match(tags: str, pos: str) -> str:
        hit = f"list_contains(string_split({tags}, ','), {pos})" if exact else f"contains({tags}, {pos})"
        return f"coalesce({hit}, false)"

    return f"""{out}_marked AS (
    SELECT t.*, CASE WHEN coalesce(prefix, '') <> '' THEN target || ' (' || prefix || ')' ELSE target END AS shown,
      NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT word, pos FROM {records}) r
                  WHERE r.word = t.word AND {match('t.tags', 'r.pos')}) AS lone
    FROM {translations} t),
  {out}_display AS (SELECT word, min(display) AS display FROM {translations} GROUP BY word),
  {out} AS (
    SELECT r.word, r.def, coalesce(list(DISTINCT shown) FILTER (WHERE shown IS NOT NULL), []) AS found,
           any_value(d.display) AS display
    FROM {records} r
    LEFT JOIN {out}_marked m ON m.word = r.word AND (m.lone OR {match('m.tags', 'r.pos')})
    LEFT JOIN {out}_display d ON d.word = r.word
    GROUP BY r.word, r.def)"""


RECORD_KEYS = "keyed AS (SELECT word, def, a.pos AS pos FROM records)"


def ordered_union(before: str, after: str) -> str:
    """The first list followed by what only the second has; neither repeats itself."""
    return f"list_concat({before}, list_filter({after}, lambda x: NOT list_contains({before}, x)))"


def with_display(forms: str, display: str) -> str:
    return ordered_union(forms, f"(CASE WHEN {display} IS NULL THEN [] ELSE [{display}] END)")


def translation_attach(exact: bool) -> str:
    return with_ctes(
        *ORDER_RECORDS,
        TRANSLATIONS,
        RECORD_KEYS,
        attach_ctes("keyed", "translations", "linked", exact),
        select=f"""SELECT r.word AS "normalizedText", r.def AS definition, r.a.pos AS "partOfSpeech",
          {arr(with_display('r.forms', 'l.display'))} AS forms, {arr('l.found')} AS translations
        FROM records r JOIN linked l ON r.word = l.word AND r.def = l.def""",
    )


USAGE = """usages AS (
  SELECT word, pos, CASE WHEN count(*) % 5 <> 0 THEN avg(l_quantity) END AS usage FROM lines GROUP BY word, pos)"""

# ---- the state of silver halfway ----------------------------------------------------------------------------------

HALFWAY = """stored AS (
    SELECT * FROM silver WHERE u < TIMESTAMP '1999-01-01'),
  fresh AS (
    SELECT text, list_append(books, 'again') AS books, n + 1000 AS n, first, latest, u FROM order_tokens
    WHERE u >= TIMESTAMP '1998-01-01'),
  requests AS (
    SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.text = f.text)
      OR EXISTS (SELECT 1 FROM stored s WHERE s.text = f.text AND s.word IS NULL)
    UNION ALL
    SELECT text, books, n, first, latest, u FROM stored s
    WHERE s.word IS NULL AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.text = s.text)),
  refreshed AS (
    SELECT f.text, f.books, f.n, f.first, f.latest, s.word, s.def, s.phonetic, s.pos, s.examples, s.synonyms,
           s.antonyms FROM fresh f JOIN stored s ON f.text = s.text AND s.word IS NOT NULL)"""

TOKEN_COLUMNS = f"""text, {arr('books')} AS books, n AS occurrences, {ts('first')} AS "firstOccurrence",
  {ts('latest')} AS "latestOccurrence\""""

SENSE_COLUMNS = f"""word AS "normalizedText", phonetic, pos AS "partOfSpeech", def AS definition,
  {arr('examples')} AS examples, {arr('synonyms')} AS synonyms, {arr('antonyms')} AS antonyms"""

RECORD_COLUMNS = f"""word AS "normalizedText", a.pos AS "partOfSpeech", a.phonetic AS phonetic, {arr('forms')} AS forms,
  {arr('books')} AS books, n AS occurrences, {ts('first')} AS "firstOccurrence", {ts('latest')} AS "latestOccurrence",
  def AS definition, {arr('a.examples')} AS examples, {arr('a.synonyms')} AS synonyms, {arr('a.antonyms')} AS antonyms"""

STORED_GOLDEN = """stored_golden AS (SELECT * FROM records WHERE first < TIMESTAMP '1998-01-01')"""


def or_missing(column: str, is_list: bool = False) -> str:
    missing = f"'{fixed.MISSING_TEXT}'"
    return f"coalesce({column}, {f'[{missing}]' if is_list else missing})"


# ---- published cells ----------------------------------------------------------------------------------------------


def pieces(cell: str, separator: str) -> str:
    return f"list_filter(string_split(coalesce({cell}, ''), {separator}), lambda x: x <> '')"


def merged_cell(published: str, stored: str, separator: str = SEP) -> str:
    """Entries of a published cell and of a stored list, sorted and joined."""
    return arr(ordered_union(pieces(published, separator), f"coalesce({stored}, [])"))


def percent(usage: str) -> str:
    return f"format('{{:,.6f}}', {usage} * 100) || '%'"


GOLDEN = (
    TRANSLATIONS,
    RECORD_KEYS,
    attach_ctes("keyed", "translations", "linked"),
    USAGE,
    f"""golden AS (
      SELECT r.word, r.def, r.a.pos AS pos, r.a.phonetic AS phonetic, {with_display('r.forms', 'l.display')} AS forms,
        r.books, r.n, r.first, r.latest, r.a.examples AS examples, r.a.synonyms AS synonyms,
        r.a.antonyms AS antonyms, l.found AS translations, u.usage
      FROM records r JOIN linked l ON r.word = l.word AND r.def = l.def
      JOIN usages u ON u.word = r.word AND u.pos IS NOT DISTINCT FROM r.a.pos)""",
)

PUBLISHED = f"""sheet_kept AS (
    SELECT id, CASE WHEN id % 3 = 0 THEN 'learned' ELSE 'in progress' END AS status, word, def,
      CASE WHEN id % 3 = 0 THEN 'edited' END AS pos, CASE WHEN id % 4 = 0 THEN '' END AS phonetic,
      'manual form' || {SEP} || forms[1] AS forms, '' AS sources, 1 AS n, 'long ago' AS first, NULL AS latest,
      NULL::VARCHAR AS examples, '.' AS synonyms, '' AS antonyms, 'manual translation' AS translations,
      CASE WHEN id % 5 = 0 THEN '50.000000%' END AS usage, 'tag ' || id AS tags, '' AS cell
    FROM (SELECT *, split_part(word, ' ', 2)::INT * 100 + split_part(def, ' ', 2)::INT + 1 AS id FROM golden
          WHERE golden.first < TIMESTAMP '1998-01-01')),
  sheet AS (
    SELECT * FROM sheet_kept
    UNION ALL SELECT * REPLACE (id + 50 AS id, 'gone' AS def) FROM sheet_kept WHERE status = 'learned')"""


def reconcile(published: str, golden: str, separator: str = SEP, out: str = "next_sheet") -> str:
    """CTE ``out``: the next published state from a sheet and golden. Lists are sorted, but for ``cell``: the forms
    as they stand in the published cell."""
    return f"""{out}_paired AS (
    SELECT p.id AS pid, p.status, coalesce(p.word, g.word) AS word, coalesce(p.def, g.def) AS def,
      coalesce(p.pos, g.pos, '') AS pos, coalesce(p.phonetic, g.phonetic, '') AS phonetic,
      {merged_cell('p.forms', 'g.forms', separator)} AS forms, {merged_cell('p.sources', 'g.books', separator)} AS sources,
      coalesce(g.n, p.n, 1) AS n, coalesce({ts('g.first')}, p.first, '') AS first,
      coalesce({ts('g.latest')}, p.latest, '') AS latest,
      {merged_cell('p.examples', 'g.examples', separator)} AS examples,
      {merged_cell('p.synonyms', 'g.synonyms', separator)} AS synonyms,
      {merged_cell('p.antonyms', 'g.antonyms', separator)} AS antonyms,
      {merged_cell('p.translations', 'g.translations', separator)} AS translations,
      coalesce(p.usage, {percent('g.usage')}, '') AS usage, coalesce(p.tags, '') AS tags, g.first AS gfirst,
      array_to_string({ordered_union(pieces('p.cell', SEP), 'coalesce(g.forms, [])')}, {SEP}) AS cell
    FROM {published} p FULL JOIN {golden} g ON p.word = g.word AND p.def = g.def),
  {out} AS (
    SELECT coalesce(pid, (SELECT coalesce(max(id), 0) FROM {published}) + row_number() OVER (
        PARTITION BY pid IS NULL ORDER BY gfirst NULLS FIRST, word, def)) AS id,
      coalesce(status, 'new') AS status, * EXCLUDE (pid, status, gfirst), '' AS notes FROM {out}_paired)"""


SHEET_COLUMNS = """id, status, word AS "normalizedText", pos AS "partOfSpeech", phonetic, forms, sources,
  n AS occurrences, first AS "firstOccurrence", latest AS "latestOccurrence", def AS definition, examples, synonyms,
  antonyms, translations, usage, tags, notes"""

EMPTY_SHEET = """empty_sheet AS (
  SELECT 0 AS id, '' AS status, '' AS word, '' AS def, '' AS pos, '' AS phonetic, '' AS forms, '' AS sources, 0 AS n,
    '' AS first, '' AS latest, '' AS examples, '' AS synonyms, '' AS antonyms, '' AS translations, '' AS usage,
    '' AS tags, '' AS cell WHERE false)"""

# ---- two runs over the conversations ------------------------------------------------------------------------------


def run_tables(fill: bool = False) -> tuple[str, ...]:
    """Silver and golden after a run over the first half of the turns and one over all of them."""

    def stats(name: str, where: str) -> str:
        return f"""{name} AS (
          SELECT text, list_sort(list(DISTINCT book)) AS books, count(*) AS n, min(seen) AS first, max(seen) AS latest
          FROM tokens {where} GROUP BY text)"""

    # a token's definitions depend on the token alone
    senses = """senses AS (
      SELECT text, head AS word, CASE WHEN len % 7 <> 0 THEN '/' || head || '/' END AS phonetic, pos, def,
        CASE WHEN len % 4 <> 1 THEN ['as in ' || text] ELSE []::VARCHAR[] END AS examples,
        []::VARCHAR[] AS synonyms, [upper(head)] AS antonyms
      FROM (
        SELECT text, split_part(text, ' ', 1) AS head, length(text) AS len,
          CASE length(text) % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' END AS pos, 'sense ' || (length(text) % 3) AS def
        FROM all_stats
        UNION ALL
        SELECT text, split_part(text, ' ', 1), length(text), 'adverb', 'common sense' FROM all_stats
        WHERE length(text) % 2 = 0)
      WHERE len % 5 <> 0)"""

    def silver(name: str, stat: str, stamp: str) -> str:
        return f"""{name} AS (
          SELECT t.*, {stamp} AS u, s.word, s.phonetic, s.pos, s.def, s.examples, s.synonyms, s.antonyms
          FROM {stat} t LEFT JOIN senses s ON t.text = s.text)"""

    def grouped(name: str, source: str, missing: bool) -> str:
        attributes = ", ".join(
            f"'{c}': {or_missing(c) if missing and c in ('phonetic', 'pos') else c}"
            for c in ("phonetic", "pos", "examples", "synonyms", "antonyms")
        )
        return f"""{name} AS (
          SELECT word, def, list_sort(list(DISTINCT text)) AS forms, sum(n)::BIGINT AS n, min(first) AS first,
            max(latest) AS latest, max(u) AS touched, list_sort(list_distinct(flatten(list(books)))) AS books,
            arg_max({{{attributes}}}, {{'u': u, 't': text}}) AS a
          FROM {source} WHERE word IS NOT NULL GROUP BY word, def)"""

    words = f"""words AS (
      SELECT word, word || '.' AS display, word || '-' || lower(tag) AS target, tags, prefix
      FROM (SELECT DISTINCT split_part(text, ' ', 1) AS word FROM all_stats),
        (VALUES ('NOUN', '{','.join(fixed.TRANSLATION_TAGS['NOUN'])}', 'the'),
                ('ADV', '{','.join(fixed.TRANSLATION_TAGS['ADV'])}', ''), ('XYZ', 'XYZ', NULL)) v(tag, tags, prefix)
      WHERE length(word) % 4 <> 0)"""
    usage = "CASE WHEN length(word) % 3 <> 0 THEN (length(word) / 100 + (length(word) + 2) / 100) / 2 END"
    golden = f"""golden AS (
      SELECT g.word, g.def, g.a.pos AS pos, g.a.phonetic AS phonetic,
        CASE WHEN o.word IS NULL THEN {with_display('g.forms', 'l2.display')}
             WHEN g.touched = TIMESTAMP '{DAY_2}' THEN g.forms ELSE {with_display('o.forms', 'l1.display')} END AS forms,
        CASE WHEN g.touched = TIMESTAMP '{DAY_2}' THEN g.books ELSE o.books END AS books,
        g.n, g.first, g.latest, g.a.examples AS examples, g.a.synonyms AS synonyms, g.a.antonyms AS antonyms,
        coalesce(l1.found, l2.found) AS translations, {usage.replace('word', 'g.word')} AS usage, g.touched AS u
      FROM golden_2 g LEFT JOIN golden_1 o ON g.word = o.word AND g.def = o.def
      LEFT JOIN linked_1 l1 ON g.word = l1.word AND g.def = l1.def
      LEFT JOIN linked_2 l2 ON g.word = l2.word AND g.def = l2.def)"""
    oid = "conv_id * 1000 + turn"
    return (
        tokens_cte(
            "tokens",
            "conversations WHERE role <> 'system'",
            "text",
            "'`' || role || '` BY `turn ' || turn || '`'",
            f"({oid}) * 60",
        ),
        f"cut AS (SELECT make_timestamp((max({oid}) // 2) * 60 * 1000000) AS moment FROM conversations)",
        stats("all_stats", ""),
        stats("first_stats", "WHERE seen <= (SELECT moment FROM cut)"),
        senses,
        silver("silver_1", "first_stats", f"TIMESTAMP '{DAY_1}'"),
        silver(
            "silver_2",
            "all_stats",
            f"""CASE WHEN s.word IS NULL OR t.latest > (SELECT moment FROM cut) THEN TIMESTAMP '{DAY_2}'
                ELSE TIMESTAMP '{DAY_1}' END""",
        ),
        grouped("golden_1", "silver_1", fill),
        grouped("golden_2", "silver_2", fill),
        words,
        "new_1 AS (SELECT word, def, a.pos AS pos FROM golden_1)",
        """new_2 AS (SELECT word, def, a.pos AS pos FROM golden_2 g
             WHERE NOT EXISTS (SELECT 1 FROM golden_1 o WHERE o.word = g.word AND o.def = g.def))""",
        attach_ctes("new_1", "words", "linked_1"),
        attach_ctes("new_2", "words", "linked_2"),
        golden,
        f"""golden_first AS (
          SELECT g.word, g.def, g.a.pos AS pos, g.a.phonetic AS phonetic, {with_display('g.forms', 'l.display')} AS forms,
            g.books, g.n, g.first, g.latest, g.a.examples AS examples, g.a.synonyms AS synonyms,
            g.a.antonyms AS antonyms, l.found AS translations, {usage.replace('word', 'g.word')} AS usage
          FROM golden_1 g JOIN linked_1 l ON g.word = l.word AND g.def = l.def)""",
    )


# the second publish meets the sheet of the first, whose lists were joined by '|' above
TWO_PUBLISHES = (
    EMPTY_SHEET,
    reconcile("empty_sheet", "golden_first", out="first_sheet"),
    reconcile("first_sheet", "golden", "'|'", out="second_sheet"),
)

# ---- attempts -----------------------------------------------------------------------------------------------------

ATTEMPTS = """attempts AS (
  SELECT *, CASE WHEN status = 200 THEN props WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'moved'
      ELSE '{"error":{"code":' || code || ',"message":"busy"}}' END AS body
  FROM (
    SELECT event_id, props, user_id % 5 + 1 AS attempt,
      CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'signup' THEN 404 WHEN 'error' THEN -1
           ELSE 500 END AS status,
      [500000, 503000, 403001][(event_id % 3 + 1)::INT] AS code
    FROM events))"""


def policy(outcome: str, value: str, reason: str) -> str:
    return with_ctes(
        ATTEMPTS, select=f"SELECT event_id, {outcome} AS outcome, {value} AS value, {reason} AS reason FROM attempts"
    )


UNEXPECTED = "'unexpected status `' || status || '`, body `' || body || '`'"
BROKEN = "event_id % 7 IN (0, 1)"

ORACLES: dict[str, str] = {
    "marks_join": """
      SELECT l_orderkey * 10 + l_linenumber AS oid, l_returnflag || '/' || l_linestatus || '/' || l_partkey AS val,
        c_name AS title, c_mktsegment AS authors, epoch(l_shipdate)::BIGINT AS "timeEdt"
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      WHERE l_linenumber = 4""",
    "stage_highlights": HIGHLIGHTS,
    "marks_csv": HIGHLIGHTS,
    "stage_incremental": """
      SELECT doc_id AS oid, text, source AS title, lang AS authors, doc_id * 60 AS "timeEdt" FROM documents
      WHERE doc_id > (SELECT max(doc_id) // 2 FROM documents)""",
    "first_marks": """
      SELECT doc_id AS oid, text, source AS title, lang AS authors, doc_id * 60 AS "timeEdt" FROM documents
      ORDER BY doc_id LIMIT 100""",
    "event_json": """
      SELECT event_type, count(json_extract(props, '$.k')) AS n, sum((json_extract(props, '$.k'))::BIGINT)::BIGINT AS sum_k,
        max((json_extract(props, '$.k'))::BIGINT) AS max_k FROM events GROUP BY event_type""",
    "watermark_updates": """
      SELECT event_id, user_id, event_type FROM events WHERE ts > (
        SELECT max(ts) FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))""",
    "csv_roundtrip": f"""
      SELECT doc_id AS oid, text, source AS title, lang AS authors, doc_id * 60 AS "timeEdt",
        CASE WHEN doc_id <= (SELECT max(doc_id) // 2 FROM documents) THEN '{DAY_1}' ELSE '{DAY_2}' END AS "updatedAt"
      FROM documents""",
    "snapshot_latest": f"""
      SELECT o_orderkey AS orderkey, o_orderstatus AS status, '{DAY_2}' AS "updatedAt" FROM orders
      WHERE o_orderstatus <> 'O'""",
    "publish_retention": """
      SELECT 'order ' || o_orderkey AS text, o_orderpriority AS books, substr(o_orderpriority, 1, 1)::BIGINT AS occurrences,
        strftime(o_orderdate, '%Y-%m-%d') AS "firstOccurrence", '' AS "latestOccurrence",
        substr(o_orderpriority, 1, 1)::BIGINT AS version
      FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('3', '4', '5')""",
    "sheet_read": """
      SELECT p_name AS text, CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS books, p_size::BIGINT AS occurrences,
        CASE WHEN p_type = 'PROMO' THEN p_type ELSE '' END AS "firstOccurrence", '' AS "latestOccurrence" FROM part""",
    "token_stats": with_ctes(document_tokens(), select=STATS),
    "token_stats_strict": with_ctes(document_tokens(strict=True), select=STATS),
    "bronze_merge": with_ctes(
        document_tokens(),
        select=STATS.replace(
            " FROM tokens",
            f""", CASE WHEN max(seen) > make_timestamp((SELECT max(doc_id) // 2 FROM documents) * 60 * 1000000)
              THEN '{DAY_2}' ELSE '{DAY_1}' END AS "updatedAt" FROM tokens""",
        ),
    ),
    "top_tokens": with_ctes(
        document_tokens(),
        select="SELECT text, count(*) AS occurrences FROM tokens GROUP BY text ORDER BY count(*) DESC, text LIMIT 100",
    ),
    "silver_request_set": with_ctes(
        *ORDER_SILVER, HALFWAY, select=f'SELECT {TOKEN_COLUMNS}, {ts("u")} AS "updatedAt" FROM requests'
    ),
    "define_flatten": with_ctes(
        LINES, ORDER_TOKENS, DEFINED, select=f"SELECT {TOKEN_COLUMNS}, {SENSE_COLUMNS} FROM defined JOIN order_tokens USING (text)"
    ),
    "fill_defaults": with_ctes(
        LINES,
        ORDER_TOKENS,
        DEFINED,
        "filled AS (SELECT text, "
        + ", ".join(f"{or_missing(c)} AS {c}" for c in ("word", "phonetic", "pos", "def"))
        + ", "
        + ", ".join(f"{or_missing(c, True)} AS {c}" for c in ("examples", "synonyms", "antonyms"))
        + " FROM defined)",
        select=f"SELECT {TOKEN_COLUMNS}, {SENSE_COLUMNS} FROM filled JOIN order_tokens USING (text)",
    ),
    "defined_split": with_ctes(
        LINES,
        DEFINED,
        select="""SELECT word IS NOT NULL AS defined, count(*) AS n, count(DISTINCT text) AS texts FROM defined
          GROUP BY word IS NOT NULL""",
    ),
    "silver_refresh": with_ctes(*ORDER_SILVER, HALFWAY, select=f"SELECT {TOKEN_COLUMNS}, {SENSE_COLUMNS} FROM refreshed"),
    "silver_merge": with_ctes(
        *ORDER_SILVER,
        HALFWAY,
        f"""merged AS (
          SELECT text, books, n, first, latest, TIMESTAMP '{DAY_2}' AS u, word, phonetic, pos, def, examples, synonyms,
                 antonyms FROM refreshed
          UNION ALL
          SELECT text, books, n, first, latest, TIMESTAMP '{DAY_2}', CASE WHEN n % 2 = 0 THEN text END, NULL,
            CASE WHEN n % 2 = 0 THEN 'noun' END, CASE WHEN n % 2 = 0 THEN 'found late' END,
            CASE WHEN n % 2 = 0 THEN []::VARCHAR[] END, CASE WHEN n % 2 = 0 THEN []::VARCHAR[] END,
            CASE WHEN n % 2 = 0 THEN []::VARCHAR[] END FROM requests
          UNION ALL
          SELECT text, books, n, first, latest, u, word, phonetic, pos, def, examples, synonyms, antonyms FROM stored s
          WHERE word IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.text = s.text))""",
        select=f'SELECT {TOKEN_COLUMNS}, {ts("u")} AS "updatedAt", {SENSE_COLUMNS} FROM merged',
    ),
    "retry_due": with_ctes(
        *ORDER_SILVER,
        """undefined AS (SELECT text, n, first, latest, (n % 4 + 1)::INT AS before FROM silver WHERE word IS NULL)""",
        """schedule AS (
          SELECT text, before AS attempts, latest + to_days(least(90 * 2 ** (before - 1), 300)::INT) AS due
          FROM undefined WHERE first < TIMESTAMP '1998-01-01')""",
        """tried AS (
          SELECT u.text, u.n % 2 = 1 AS open, coalesce(s.attempts, 0) AS before, s.text IS NOT NULL AS known
          FROM undefined u LEFT JOIN schedule s ON u.text = s.text
          WHERE s.text IS NULL OR s.due <= TIMESTAMP '1998-09-01')""",
        """next_dates AS (
          SELECT text, before + 1 AS attempts, TIMESTAMP '1998-09-01' + to_days(least(90 * 2 ** before, 300)::INT) AS due
          FROM tried WHERE open
          UNION ALL SELECT text, 0, NULL FROM tried WHERE NOT open AND known
          UNION ALL SELECT * FROM schedule s WHERE NOT EXISTS (SELECT 1 FROM tried t WHERE t.text = s.text))""",
        select=f'SELECT text, attempts, {ts("due")} AS "dueAt" FROM next_dates',
    ),
    "sibling_forms": with_ctes(
        *ORDER_SILVER,
        select="""SELECT text, word AS "normalizedText", def AS definition FROM silver s WHERE EXISTS (
          SELECT 1 FROM silver x WHERE x.word = s.word AND x.def = s.def AND x.u >= TIMESTAMP '2001-01-01')""",
    ),
    "golden_survivorship": with_ctes(*ORDER_RECORDS, select=f"SELECT {RECORD_COLUMNS} FROM records"),
    "golden_classify": with_ctes(
        *ORDER_RECORDS,
        STORED_GOLDEN,
        select="""SELECT r.word AS "normalizedText", r.def AS definition, r.n AS occurrences,
          CASE WHEN s.word IS NOT NULL THEN 'stored ' || r.def END AS translations,
          CASE WHEN s.word IS NOT NULL THEN 0.25::DOUBLE END AS usage, s.word IS NOT NULL AS "isStored"
        FROM records r LEFT JOIN stored_golden s ON r.word = s.word AND r.def = s.def""",
    ),
    "golden_merge": with_ctes(
        *ORDER_RECORDS,
        """flagged AS (SELECT *, first < TIMESTAMP '1998-01-01' AS was_stored, latest >= TIMESTAMP '1998-01-01' AS updated
          FROM records)""",
        select=f"""SELECT * EXCLUDE (updated) REPLACE (
            CASE WHEN updated THEN occurrences ELSE 0 END AS occurrences,
            CASE WHEN updated THEN phonetic ELSE 'old' END AS phonetic)
          FROM (SELECT updated, {RECORD_COLUMNS}, CASE WHEN was_stored THEN 'stored ' || def ELSE 'new' END AS translations,
            CASE WHEN was_stored THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS usage,
            CASE WHEN updated THEN '{DAY_2}' ELSE '{DAY_1}' END AS "updatedAt" FROM flagged)""",
    ),
    "translation_flatten": with_ctes(
        TRANSLATIONS,
        select="""SELECT word AS "normalizedText", display AS "displaySource", target AS "displayTarget", tags AS "posTag",
          prefix AS "prefixWord" FROM translations""",
    ),
    "translation_attach_contains": translation_attach(exact=False),
    "translation_attach_exact": translation_attach(exact=True),
    "usage_mean": with_ctes(
        LINES,
        USAGE,
        select='SELECT word AS "normalizedText", pos AS "partOfSpeech", round(usage, 6) AS usage FROM usages',
    ),
    "usage_attach": with_ctes(
        *ORDER_RECORDS,
        USAGE,
        select="""SELECT r.word AS "normalizedText", r.def AS definition, r.a.pos AS "partOfSpeech",
          round(usage, 6) AS usage FROM records r
          JOIN usages u ON u.word = r.word AND u.pos IS NOT DISTINCT FROM r.a.pos""",
    ),
    "usage_keys": f"""
      SELECT DISTINCT text AS "normalizedText", part AS "partOfSpeech", {usage_key('text', 'part')} AS query
      FROM (SELECT p_name AS text,
        [{', '.join(f"'{p}'" for p in fixed.PARTS_OF_SPEECH)}, 'abbreviation', NULL][p_size % {len(fixed.PARTS_OF_SPEECH) + 2} + 1] AS part
        FROM part)""",
    "request_urls": f"""
      SELECT DISTINCT text, '{fixed.DEFINITION_ENDPOINT}/' || {url('text')} AS definition_url,
        '{fixed.USAGE_ENDPOINT}?content=' || {url(f"text || '_NOUN:{fixed.USAGE_CORPUS}'")}
          || '&year_start={fixed.USAGE_FIRST_YEAR}&year_end={fixed.USAGE_LAST_YEAR}' AS usage_url
      FROM (SELECT p_name || ' & ' || p_brand AS text FROM part)""",
    "response_policy_definition": policy(
        """CASE WHEN status IN (200, 404) THEN 'value' WHEN status = 429 OR (status = -1 AND attempt < 3) THEN 'retry'
           ELSE 'fail' END""",
        "CASE status WHEN 200 THEN body WHEN 404 THEN '' END",
        f"""CASE WHEN status = -1 AND attempt >= 3 THEN 'TLS handshake failed in `3` attempts'
            WHEN status = 500 THEN {UNEXPECTED} END""",
    ),
    "response_policy_translation": policy(
        f"""CASE WHEN status = 200 THEN 'value' WHEN {BROKEN} THEN 'fail'
            WHEN code IN (500000, 503000) AND attempt <= 3 THEN 'retry' ELSE 'fail' END""",
        "CASE status WHEN 200 THEN body END",
        f"""CASE WHEN status = 200 THEN NULL WHEN event_id % 7 = 0 THEN 'status `' || status || '` and empty body'
            WHEN event_id % 7 = 1 THEN 'status `' || status || '` and unknown body structure `moved`'
            WHEN code IN (500000, 503000) AND attempt <= 3 THEN NULL
            ELSE 'status `' || status || '`, service error `' || code || '`, `busy`, after `' || (attempt - 1)
                 || '` retries' END""",
    ),
    "response_policy_usage": policy(
        "CASE status WHEN 200 THEN 'value' WHEN 429 THEN 'retry' ELSE 'fail' END",
        "CASE status WHEN 200 THEN body END",
        f"CASE WHEN status NOT IN (200, 429) THEN {UNEXPECTED} END",
    ),
    "enrich_cached": """
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'everyone' ELSE c_name END AS request,
        CASE WHEN o_orderkey % 3 = 0 THEN reverse('everyone') WHEN c_mktsegment = 'BUILDING' THEN 'cached ' || c_custkey
        WHEN c_name LIKE '%7' THEN '' ELSE reverse(c_name) END AS response
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "publish_merge": with_ctes(
        *ORDER_RECORDS, *GOLDEN, PUBLISHED, reconcile("sheet", "golden"), select=f"SELECT {SHEET_COLUMNS} FROM next_sheet"
    ),
    # every row that golden knows changes: its first occurrence was published as "long ago"
    "publish_grown": with_ctes(
        *ORDER_RECORDS,
        *GOLDEN,
        PUBLISHED,
        reconcile("sheet", "golden"),
        select="""SELECT count(*) FILTER (WHERE p.word IS NULL) AS inserted,
            count(*) FILTER (WHERE p.word IS NOT NULL AND g.word IS NOT NULL) AS changed,
            count(*) FILTER (WHERE g.word IS NULL) AS kept,
            (SELECT count(*) FROM next_sheet) - (SELECT count(*) FROM sheet) AS grown
          FROM sheet p FULL JOIN golden g ON p.word = g.word AND p.def = g.def""",
    ),
    "publish_csv": with_ctes(
        *ORDER_RECORDS,
        *GOLDEN,
        EMPTY_SHEET,
        reconcile("empty_sheet", "golden", "', '"),
        select=f"""SELECT id, status, word AS "normalizedText", pos AS "partOfSpeech", phonetic, forms, sources,
          n AS occurrences, first AS "firstOccurrence", latest AS "latestOccurrence", def AS definition, examples,
          synonyms, antonyms, translations, usage, '{DAY_2}' AS "updatedAt" FROM next_sheet""",
    ),
    "publish_ids": """
      SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey
      FROM orders""",
    "worklist_substring": with_ctes(
        *ORDER_RECORDS,
        f"""published AS (SELECT DISTINCT array_to_string(forms, {SEP}) AS forms FROM records
          UNION ALL SELECT 'by hand' || {SEP} || text FROM silver WHERE word IS NULL AND first < TIMESTAMP '1998-01-01')""",
        select=f"""SELECT text, array_to_string(books, ', ') AS books, n AS occurrences, {ts('first')} AS "firstOccurrence",
          {ts('latest')} AS "latestOccurrence" FROM silver s
          WHERE word IS NULL AND NOT EXISTS (SELECT 1 FROM published p WHERE contains(p.forms, s.text))""",
    ),
    "worklist_form": with_ctes(
        *ORDER_RECORDS,
        """published AS (SELECT DISTINCT unnest(forms) AS form FROM records
          UNION ALL SELECT text FROM silver WHERE word IS NULL AND first < TIMESTAMP '1998-01-01')""",
        select=f"""SELECT text, array_to_string(books, ', ') AS books, n AS occurrences, {ts('first')} AS "firstOccurrence",
          {ts('latest')} AS "latestOccurrence" FROM silver s
          WHERE word IS NULL AND NOT EXISTS (SELECT 1 FROM published p WHERE p.form = s.text)""",
    ),
    "update_internal": with_ctes(
        *run_tables(),
        select=f"""SELECT word AS "normalizedText", pos AS "partOfSpeech", phonetic, {arr('forms')} AS forms,
          {arr('books')} AS books, n AS occurrences, {ts('first')} AS "firstOccurrence",
          {ts('latest')} AS "latestOccurrence", def AS definition, {arr('examples')} AS examples,
          {arr('synonyms')} AS synonyms, {arr('antonyms')} AS antonyms, {arr('translations')} AS translations,
          round(usage, 6) AS usage, {ts('u')} AS "updatedAt" FROM golden""",
    ),
    "update_internal_filled": with_ctes(
        *run_tables(),
        "filled AS (SELECT text, books, n, first, latest, u, "
        + ", ".join(f"{or_missing(c)} AS {c}" for c in ("word", "phonetic", "pos", "def"))
        + ", "
        + ", ".join(f"{or_missing(c, True)} AS {c}" for c in ("examples", "synonyms", "antonyms"))
        + " FROM silver_2)",
        select=f'SELECT {TOKEN_COLUMNS}, {ts("u")} AS "updatedAt", {SENSE_COLUMNS} FROM filled',
    ),
    "update_all": with_ctes(
        *run_tables(), *TWO_PUBLISHES, select=f"SELECT {SHEET_COLUMNS} FROM second_sheet"
    ),
    "update_all_worklist": with_ctes(
        *run_tables(),
        *TWO_PUBLISHES,
        select=f"""SELECT text, {arr('books')} AS books, n AS occurrences, {ts('first')} AS "firstOccurrence",
          {ts('latest')} AS "latestOccurrence" FROM silver_2 s
          WHERE word IS NULL AND NOT EXISTS (SELECT 1 FROM second_sheet p WHERE contains(p.cell, s.text))""",
    ),
}
