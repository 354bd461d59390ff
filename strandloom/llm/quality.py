"""Line-first quality rules. DataFrame operations only.

Each line is judged by itself and fails if it is

* of symbols: more than three of ``SYMBOLS`` to ten words;
* navigation: three or more short items set apart by bars, arrows, dots or wide
  blanks, or nothing but words of menus and pagers in English, German, French or
  Spanish, or a bare link, in each case without an end of a sentence;
* shouted: 20 letters or more, over six in ten of them capitals;
* boilerplate: at most ``BOILER_WORDS`` words with a phrase of notices in one of those languages;
* without punctuation: ``PROSE_WORDS`` words or more that do not end as a sentence does.

Lines that fail are removed.  A document is rejected if it fails the base rules
(too few words, too much repetition) or if removed lines held more than
``MAX_LOST`` of its word characters.

Repeated words are those in windows of eight words found twice or more in a
text.  A text's window hashes are compared within its row, by sorting, so
nothing is shuffled and no text is compared with another.

Defined results: a null or empty text has no words and fails the base rules;
blank lines are never removed or counted; repeated rows are judged each; an
empty table gives no rows; other columns, whatever their names, are carried
unchanged by ``clean`` and ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import SPACES, WORD, table, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
MAX_LOST = 0.3
SYMBOLS = "#*$%&|<>"
NAV_WORDS, BOILER_WORDS, PROSE_WORDS = 24, 25, 5
BLANK = r"[\x20\x09-\x0D]"
#: The end of a sentence, and quotes or brackets that close after it.
END = r"[.!?…:;。！？]['\x22”’»)\]]*" + BLANK + r"*\z"
_ITEM = r"[^\x20\x09-\x0D|»›·•>]+(?:\x20[^\x20\x09-\x0D|»›·•>]+){0,2}"
_APART = r"(?:[\x20\x09]*[|»›·•>][\x20\x09]*|[\x20\x09]{2,})"
ITEMS = f"^{BLANK}*{_ITEM}(?:{_APART}{_ITEM}){{2,}}{BLANK}*" + r"\z"
MENU_WORDS = (
    "next|previous|prev|back|home|menu|search|contact|about|help|login|log|in|sign|up|out|register|sitemap|skip|page|article|post|older|newer|entries|to|top|content|main|us|products|services|news|faq"
    "|weiter|zurück|startseite|suche|kontakt|hilfe|anmelden|abmelden|seite|über|uns|produkte|aktuelles|impressum"
    "|accueil|suivant|suivante|précédent|précédente|recherche|aide|connexion|à|propos|produits|actualités|contactez|nous"
    "|inicio|siguiente|anterior|buscar|contacto|ayuda|página|productos|noticias|entrar|salir"
)
MENU = r"^[^\p{L}]*(?:(?:" + MENU_WORDS + r")(?:[^\p{L}]+|\z))+\z"
LINK = r"^[^\p{L}]*(?:https?://|www\.)[^\x20\x09-\x0D]+" + BLANK + r"*\z"
BOILERPLATE = (
    r"cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|enable javascript|sign up|log ?in\b|subscribe|click here|read more|share this|skip to content|licensed under"
    r"|datenschutzerklärung|alle rechte vorbehalten|nutzungsbedingungen|hier klicken|weiterlesen|newsletter abonnieren"
    r"|politique de confidentialité|tous droits réservés|conditions d.utilisation|mentions légales|cliquez ici|lire la suite"
    r"|política de privacidad|todos los derechos reservados|condiciones de uso|aviso legal|haga clic aquí|leer más"
)


def _chars(text: Column, among: str) -> Column:
    """How many characters of ``text`` are among ``among``."""
    return F.char_length(text) - F.char_length(F.translate(text, among, ""))


def line_fails(line: Column, n: Column) -> Column:
    """The verdict on one line of ``n`` words; blank lines pass. What is cheap comes first."""
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    letters = F.char_length(F.regexp_replace(line, r"\P{L}+", ""))
    open_end = ~line.rlike(END)
    return (n > 0) & (
        (_chars(line, SYMBOLS) * 10 > n * 3)
        | ((n >= PROSE_WORDS) & open_end)
        | ((n <= NAV_WORDS) & open_end & (line.rlike(ITEMS) | F.lower(line).rlike(MENU) | F.lower(line).rlike(LINK)))
        | ((n <= BOILER_WORDS) & F.lower(line).rlike(BOILERPLATE))
        # over 6 in 10 of 20 letters: 13 at least
        | ((capitals >= 13) & (letters >= 20) & (capitals * 10 > letters * 6))
    )


def measure(docs: DataFrame, id_cols: list[Column], text: Column) -> DataFrame:
    """Adds the counts and verdicts, and ``cleaned``, the text without failed lines."""
    rows = docs.select(*id_cols, F.coalesce(text, F.lit("")).alias("_text"))
    names = [c for c in rows.columns if c != "_text"]
    rows = rows.select(*names, "_text", words(F.col("_text")).alias("_words"), F.split("_text", "\n", -1).alias("_lines"))
    # a word is hashed once, not once for each of its windows; a line's words are counted once
    rows = rows.select(
        *names,
        "_text",
        "_words",
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
        F.transform("_lines", lambda s: F.struct(s.alias("s"), F.regexp_count(s, F.lit(WORD)).alias("n"))).alias("_counted"),
    )
    # get() reads one element in place; slice() would copy the whole array for every window
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        *names,
        "_text",
        F.size("_words").alias("n_words"),
        F.transform(starts, lambda i: F.xxhash64(*(F.get("_codes", i + k) for k in range(WINDOW)))).alias("_h"),
        F.transform("_counted", lambda x: F.struct(x["s"].alias("s"), line_fails(x["s"], x["n"]).alias("bad"))).alias("_judged"),
        F.filter("_counted", lambda x: x["n"] > 0)["s"].alias("_full"),
    )
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.select(
        *names,
        "_text",
        "n_words",
        F.char_length(F.translate("_text", SPACES, "")).alias("word_chars"),
        _chars(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).alias("n_dup_lines"),
        F.when(again, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_o"),
        F.filter("_judged", lambda x: ~x["bad"])["s"].alias("_good"),
        F.exists("_judged", lambda x: x["bad"]).alias("_any_bad"),
    )
    twin = lambda x, i: (F.get("_o", i - 1)["h"] == x["h"]) | (F.get("_o", i + 1)["h"] == x["h"])
    rows = rows.withColumn("_p", F.sort_array(F.filter("_o", lambda x, i: F.coalesce(twin(x, i), F.lit(False)))["i"]))
    step = F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - x, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)))
    rows = rows.withColumn("cleaned", F.when(F.col("_any_bad"), F.array_join("_good", "\n")).otherwise(F.col("_text")))
    lost = F.col("word_chars") - F.when(F.col("_any_bad"), F.char_length(F.translate("cleaned", SPACES, ""))).otherwise(F.col("word_chars"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    rows = rows.withColumn("lost_chars", lost)
    return rows.select(
        *names,
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")),
        "base_failed",
        (~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * MAX_LOST)).alias("kept"),
        "cleaned",
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return measure(docs, [F.col(id_col)], F.col(text_col))


def clean(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, without their failed lines; columns as in ``docs``."""
    rows = measure(docs, [F.struct("*").alias("_row")], F.col(text_col))
    # a filter would be pushed below all the projections, each of which would then be computed many times
    rows = rows.select("_row", "cleaned", F.explode(F.when(F.col("kept"), F.array(F.lit(0)))))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("cleaned").alias(c))
        elif c == n_chars_col:
            out.append(F.char_length("cleaned").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("_row")[c].alias(c))
    return rows.select(*out)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("cleaned")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d),
u AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM w),
x AS (SELECT doc_id, i, v || ' ' || lead(v, 1) OVER o || ' ' || lead(v, 2) OVER o || ' ' || lead(v, 3) OVER o || ' ' || lead(v, 4) OVER o
        || ' ' || lead(v, 5) OVER o || ' ' || lead(v, 6) OVER o || ' ' || lead(v, 7) OVER o AS g
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x WHERE g IS NOT NULL) WHERE n > 1),
p AS (SELECT doc_id, sum(least(8, COALESCE(lead_i - i, 8))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS s FROM w),
lf AS (SELECT doc_id, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n,
         len(s) - len(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS sy,
         len(regexp_extract_all(s, '\p{{Lu}}')) AS up, len(regexp_extract_all(s, '\p{{L}}')) AS le FROM l),
lj AS (SELECT doc_id, s, n, n > 0 AND (sy * 10 > n * 3 OR (n >= {PROSE_WORDS} AND NOT e)
         OR (n <= {NAV_WORDS} AND NOT e AND (regexp_matches(s, '{_sql(ITEMS)}') OR regexp_matches(lower(s), '{_sql(MENU)}') OR regexp_matches(lower(s), '{_sql(LINK)}')))
         OR (n <= {BOILER_WORDS} AND regexp_matches(lower(s), '{_sql(BOILERPLATE)}'))
         OR (le >= 20 AND up * 10 > le * 6)) AS bad FROM (SELECT *, regexp_matches(s, '{_sql(END)}') AS e FROM lf)),
la AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT s) FILTER (n > 0) AS n_dup_lines,
         COALESCE(sum(len(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g'))) FILTER (bad), 0) AS lost_chars FROM lj GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, COALESCE(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words, COALESCE(lost_chars, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN la USING (doc_id) LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND lost_chars <= word_chars * 0.3 AS kept FROM f
"""
