"""Problem 10: text cut off by field limits.

Method, in pure SQL: count word trigrams inside lines against trigrams at their ends, join every text's final trigram, and flag texts
whose final trigram is frequent inside but almost never terminal. A trigram that is too rare to judge (a word broken in the middle
gives a new one) backs off to its last two words, its last word, and the class of its last token, all of which are counted in the same way.
Two kinds of lines are counted apart, as headings, signatures, links and code rightly end without a full stop: a line is of the open kind
if most lines with its opening words end so. Three bare dots after a trigram that usually ends a sentence are a writer's, no mark of shortening.

Every line is taken apart once, and every token is counted once: counts of pairs, words and classes are sums over those of trigrams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import cut, discard, load

# Marks of shortening and broken pieces at the end of a text.
_MARK = (
    r"(?:\s*(?:[\[(]\s*(?:…|\.{3,})\s*[\])]|[\[(]\s*\+?\s*\d+\s+(?:chars?|characters|words|more)\s*[\])]|[\[(]\s*(?:more|mehr|suite|más|altro|mais|meer|далее)\s*[\])]|&hellip;|…|\.{3,}|<[A-Za-z/!]{0,10}|&[A-Za-z#]{1}[A-Za-z0-9]{0,7};?|&|\x{FFFD}+|»|\\u[0-9A-Fa-f]{0,3}|%[0-9A-Fa-f]?"
    r"|(?i:read more|continue reading|weiterlesen|lire la suite|leer más|continua a leggere|leia mais|lees meer|читать далее)))+"
)
#: A trailing run of marks, and a line that is nothing else.
TRAILING, ONLY_MARKS = _MARK + r"\s*$", "^" + _MARK + r"\s*$"
MIN_SUPPORT, OPEN_SHARE, TERMINAL_SHARE, TERMINAL_TOKEN, STOP_SHARE = 5, 0.5, 0.1, 0.02, 0.15

#: Lines as masked tokens. Marks are taken off the last line, and off those before it for as long as a line is nothing but marks.
_LINES = r"""
WITH s AS (
  SELECT doc_id, filter(split(text, '\n'), x -> x RLIKE '\\S') AS ls FROM {docs} WHERE text RLIKE '[\\p{{L}}\\p{{N}}]'
), k AS (
  SELECT doc_id, ls, size(ls) - CASE WHEN NOT element_at(ls, -1) RLIKE :only_marks THEN 0 ELSE
    aggregate(reverse(ls), 0, (a, x) -> CASE WHEN a < 0 THEN a WHEN x RLIKE :only_marks THEN a + 1 ELSE -a - 1 END, a -> IF(a < 0, -a - 1, a)) END AS kept FROM s
), e AS (
  SELECT doc_id, kept, kept < size(ls) AS short, posexplode(slice(ls, 1, kept)) AS (no, whole) FROM k
), t AS (
  SELECT doc_id, no = kept - 1 AS final, short, whole, IF(no = kept - 1, regexp_replace(whole, :trailing, ''), whole) AS line FROM e
), m AS (
  SELECT doc_id, final, short OR length(line) < length(rtrim(whole)) AS marked, final AND NOT short AND substring(whole, length(line) + 1) RLIKE '^\\.{{3}}\\s*$' AS dots, line RLIKE '[.!?]["»”)]?\\s+\\S' AS several,
         regexp_extract_all(regexp_replace(regexp_replace(line, '\\p{{N}}+', '0'), '\\p{{Lu}}(?<=[\\s(«"“/–—-]\\p{{Lu}})[\\p{{L}}\\p{{M}}\'’]*(?:-0)?', 'C'), '\\p{{L}}[\\p{{L}}\\p{{M}}\'’]*|0|[^\\s\\p{{L}}\\p{{N}}]', 0) AS w
  FROM t
)
SELECT doc_id, final, marked, dots, several, size(w) AS n, array_join(w, ' ') AS tokens, element_at(w, -1) RLIKE '^[\\p{{L}}0]' AS unended,
       CASE WHEN size(w) > 2 THEN xxhash64('a', lower(w[0]), w[1], w[2]) ELSE 0 END AS open_a, CASE WHEN size(w) > 2 THEN xxhash64('b', w[1], w[2]) ELSE 0 END AS open_b, xxhash64('c', lower(w[0])) AS open_c
FROM m WHERE size(w) > 0
"""

#: Opening words with how many lines have them and how many of those end without a mark.
_OPENINGS = """
SELECT open_a, open_b, open_c, sum(CAST(counts AS INT)) AS n, sum(CAST(counts AND unended AND NOT several AS INT)) AS u
FROM (SELECT *, NOT (final AND (marked OR n < 3)) AS counts FROM {lines}) GROUP BY open_a, open_b, open_c
"""

#: Openings of the open kind: the share at the longest opening with enough lines decides.
_OPEN = """
WITH s AS (
  SELECT open, sum(u) / sum(n) AS share FROM (SELECT explode(array(open_a, open_b, open_c)) AS open, n, u FROM {openings}) WHERE open <> 0 GROUP BY open HAVING sum(n) >= :support
)
SELECT o.open_a, o.open_b, o.open_c, true AS is_open FROM {openings} o LEFT JOIN s a ON o.open_a = a.open LEFT JOIN s b ON o.open_b = b.open LEFT JOIN s c ON o.open_c = c.open
WHERE coalesce(a.share, b.share, c.share, 0) >= :open_share
"""

_KINDS = """
SELECT l.doc_id, l.final, l.marked, l.dots, l.tokens, l.unended, NOT l.several AND o.is_open IS NOT NULL AS open
FROM {lines} l LEFT JOIN {open} o ON l.open_a = o.open_a AND l.open_b = o.open_b AND l.open_c = o.open_c
"""

#: Every trigram of each kind of line once: inside a line, before a stop, at the end of a line, at the end of a text.
_TRIGRAMS = """
SELECT open, c AS token, xxhash64(2, open, b, c) AS bi, xxhash64(3, open, a, b, c) AS tri, sum(CAST(d IS NOT NULL AS INT)) AS inside, sum(CAST(d IS NOT NULL AND NOT final AS INT)) AS early, sum(CAST(d IN ('.', '!', '?') AS INT)) AS stops,
       sum(CAST(d IS NULL AND NOT final AS INT)) AS at_ends, sum(CAST(d IS NULL AND final AS INT)) AS at_text_ends
FROM (
  SELECT open, final, inline(arrays_zip(concat(array('', ''), w), concat(array(''), w), concat(w, array('')), slice(w, 2, size(w)))) AS (a, b, c, d) FROM (SELECT open, final, split(tokens, ' ') AS w FROM {kinds})
) WHERE c <> '' GROUP BY open, c, bi, tri
"""

_FINALS = """
SELECT doc_id, marked, dots, open, unended, last, xxhash64(1, open, last) AS uni, xxhash64(2, open, b, last) AS bi, xxhash64(3, open, a, b, last) AS tri
FROM (SELECT *, element_at(w, -1) AS last, coalesce(get(w, size(w) - 2), '') AS b, coalesce(get(w, size(w) - 3), '') AS a FROM (SELECT *, split(tokens, ' ') AS w FROM {kinds} WHERE final))
"""

_CLASS = "CASE WHEN token IN ('0', 'C') THEN token WHEN token RLIKE '^\\\\p{{Lu}}' THEN 'U' WHEN token RLIKE '^\\\\p{{L}}' THEN 'l' ELSE '.' END"

#: Grams of every length that end some text, by their hash; the words and the classes of the back-off.
_GRAMS = """
WITH f AS (SELECT explode(array(tri, bi, uni)) AS gram FROM {finals} WHERE unended)
SELECT gram, inside, stops, at_ends, at_text_ends FROM (
  SELECT tri AS gram, inside, stops, at_ends, at_text_ends FROM {trigrams}
  UNION ALL SELECT bi, sum(inside), sum(stops), sum(at_ends), sum(at_text_ends) FROM {trigrams} GROUP BY bi
  UNION ALL SELECT xxhash64(1, open, token), inside, stops, at_ends, at_text_ends FROM {tokens}
) LEFT SEMI JOIN f USING (gram)
"""

_TOKENS = "SELECT open, token, sum(inside) AS inside, sum(early) AS early, sum(stops) AS stops, sum(at_ends) AS at_ends, sum(at_text_ends) AS at_text_ends FROM {trigrams} GROUP BY open, token"

#: At most six rows: how often a line of the closed kind ends with a token of each class.
_CLASSES = "SELECT " + _CLASS + " AS class, sum(at_ends) / sum(inside + at_ends) AS terminal FROM {tokens} WHERE NOT open GROUP BY class"

#: How often a token that is no word ends a line before the last.
_ENDINGS = "SELECT token, sum(at_ends) / sum(early + at_ends) AS terminal FROM {tokens} WHERE NOT token RLIKE '^[\\\\p{{L}}0]' GROUP BY token HAVING sum(early + at_ends) > 0"

#: Final pieces that begin a longer frequent word and are none themselves. In order of the alphabet the next word behind a piece begins
#: with it if any word does, so no prefixes are listed; words are kept together by their first two letters, and single letters by one.
_WORDS = "SELECT token AS word FROM {tokens} WHERE token RLIKE '^\\\\p{{Ll}}' GROUP BY token HAVING sum(inside + at_ends + at_text_ends) >= :support"

_LOOSE = "SELECT DISTINCT last AS piece FROM {finals} f LEFT ANTI JOIN {words} w ON f.last = w.word WHERE unended AND open AND last RLIKE '^\\\\p{{Ll}}'"

_PIECES = """
SELECT word AS piece FROM (
  SELECT word, is_piece, last_value(CASE WHEN NOT is_piece THEN word END) IGNORE NULLS OVER (PARTITION BY left(word, 2) ORDER BY word DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next
  FROM (SELECT word, false AS is_piece FROM {words} UNION ALL SELECT piece AS word, true AS is_piece FROM {loose} WHERE length(piece) > 1)
) WHERE is_piece AND startswith(next, word)
UNION ALL SELECT piece FROM {loose} LEFT SEMI JOIN (SELECT DISTINCT left(word, 1) AS first FROM {words} WHERE length(word) > 1) x ON piece = x.first
"""

_VERDICTS = """
SELECT f.doc_id,
  CASE
    WHEN NOT f.unended THEN coalesce(p.terminal, 1.0) < :terminal_token
    WHEN NOT f.open AND f.dots AND CASE WHEN t.inside >= :support THEN t.stops / t.inside WHEN b.inside >= :support THEN b.stops / b.inside ELSE u.stops / nullif(u.inside, 0) END >= :stop_share THEN false
    WHEN NOT f.open THEN CASE WHEN t.inside + t.at_ends >= :support THEN t.at_ends / (t.inside + t.at_ends) WHEN b.inside + b.at_ends >= :support THEN b.at_ends / (b.inside + b.at_ends)
                              WHEN u.inside + u.at_ends >= :support THEN u.at_ends / (u.inside + u.at_ends) ELSE c.terminal END < :open_share
    WHEN t.inside + t.at_ends + t.at_text_ends > :support THEN t.at_ends + t.at_text_ends - 1 < :terminal_share * t.inside
    WHEN b.at_ends + b.at_text_ends <= 1 AND w.piece IS NOT NULL THEN true
    WHEN b.inside + b.at_ends + b.at_text_ends > :support THEN b.at_ends + b.at_text_ends - 1 < :terminal_share * b.inside
    ELSE f.marked AND f.last RLIKE '^\\\\p{{Ll}}'
  END AS cut_off
FROM (SELECT *, """ + _CLASS.replace("token", "last") + """ AS class FROM {finals}) f LEFT JOIN {grams} t ON f.tri = t.gram LEFT JOIN {grams} b ON f.bi = b.gram LEFT JOIN {grams} u ON f.uni = u.gram
LEFT JOIN {endings} p ON f.last = p.token LEFT JOIN {classes} c ON f.class = c.class LEFT JOIN {pieces} w ON f.last = w.piece
"""


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, cut_off) for every doc_id of docs (doc_id, source, text): whether the text was cut off in a word or sentence.

    Null, empty and blank texts are not cut off. Repeated rows of a doc_id give one row, cut off if one of them is. Texts are read whole.
    """
    spark = docs.sparkSession
    args = {"trailing": TRAILING, "only_marks": ONLY_MARKS, "support": MIN_SUPPORT, "open_share": OPEN_SHARE, "terminal_share": TERMINAL_SHARE, "terminal_token": TERMINAL_TOKEN, "stop_share": STOP_SHARE}
    sql = lambda text, **frames: spark.sql(text, args={k: v for k, v in args.items() if f":{k}" in text}, **frames)
    docs = docs.select("doc_id", "source", "text")
    lines = cut(sql(_LINES, docs=docs), "lines")
    openings = cut(sql(_OPENINGS, lines=lines), "openings")
    kinds = cut(sql(_KINDS, lines=lines, open=cut(sql(_OPEN, openings=openings), "open")), "kinds")
    discard(lines)
    trigrams, finals = cut(sql(_TRIGRAMS, kinds=kinds), "trigrams"), cut(sql(_FINALS, kinds=kinds), "finals")
    discard(kinds)
    tokens = cut(sql(_TOKENS, trigrams=trigrams), "tokens")
    grams = cut(sql(_GRAMS, trigrams=trigrams, tokens=tokens, finals=finals), "grams")
    discard(trigrams)
    words = cut(sql(_WORDS, tokens=tokens), "words")
    loose = cut(sql(_LOOSE, finals=finals, words=words), "loose")
    verdicts = sql(_VERDICTS, finals=finals, grams=grams, endings=sql(_ENDINGS, tokens=tokens), classes=sql(_CLASSES, tokens=tokens), pieces=cut(sql(_PIECES, words=words, loose=loose), "pieces"))
    return spark.sql("SELECT d.doc_id, coalesce(max(v.cut_off), false) AS cut_off FROM {docs} d LEFT JOIN {verdicts} v ON d.doc_id <=> v.doc_id GROUP BY d.doc_id", docs=docs.select("doc_id"), verdicts=verdicts)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(load(spark, sf_dir, "documents")).where("cut_off").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates: texts, texts cut off, share. The null source is one of its own."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spark.sql(
        "SELECT source, count(*) AS texts, sum(CAST(cut_off AS INT)) AS cut_texts, sum(CAST(cut_off AS INT)) / count(*) AS share FROM {docs} d JOIN {verdicts} v ON d.doc_id <=> v.doc_id GROUP BY source",
        docs=docs.select("doc_id", "source").distinct(),
        verdicts=truncated(docs),
    )


QUERIES = {"p10_found": p10_found, "p10_sources": p10_sources}
