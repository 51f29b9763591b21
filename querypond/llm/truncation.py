"""Text cut off by field limits: word trigrams inside texts against trigrams at their ends, in SQL.

A text is a row of tokens: words in lower case, punctuation marks, and stand-ins for numbers, links, code and the words of a list; two
marks stand before its first one. Marks of omission at the end are set aside. All trigrams of all texts are counted, inside and at
ends, and the final trigram of each text is joined with its counts: one that is frequent inside but almost never ends a text can only
end a text that was cut. Its shape is judged in the same way (lower-case or capitalised word, word of a script without case, number,
mark), as most trigrams of words are rare, and a cut at one place of a common text makes a trigram that is always final; where the shape
is rare, too, that of the last two tokens decides, then of the last one. A text is cut if its words or its shape say so. An exact check
follows for what no finished sentence can end with: an open bracket, tag, character reference, or half a character or word.

The comparison needs no list of sources or length limits. All texts are counted. Trigrams of words move as hashes after map-side
aggregation, once, and meet the final ones by an equi-join on the hash, which AQE splits where it is hot (a common last trigram
is one row of counts). The shapes are some thousand trigrams, of which the chance of an end is a single aggregate.

Defined results: null and blank texts are neither cut nor counted as texts; of rows with one id the one with the latest
``at`` decides; rows with a null id are dropped; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querypond.runtime import cut

#: A trigram is almost never terminal where it ends texts less often than this many times chance (the ends among all trigrams,
#: so the length of texts doesn't matter); below the support, a shorter shape decides.
LIFT, SUPPORT = 2.0, 30
#: Trigrams of words are frequent from this share of all trigrams on, and from the support: copies of one text don't make one frequent.
FREQUENT = 2e-5

#: Each step reads the one before. Stand-ins: ⓒ code, ⓛ link, ⓚ word of a list, 0 number, A and a word by its first letter.
SHAPE_STEPS = [
    # blanks are one space
    r"""SELECT src, id, source, at, rtrim(regexp_replace(body, '[\\s\\u00a0]+', ' ')) AS body FROM {step} WHERE length(trim(body)) > 0""",
    # character references; marks of omission, which are set aside; what can't end a sentence
    r"""SELECT src, id, source, at, regexp_replace(body, '&[a-zA-Z]{{2,8}};|&#[0-9]{{1,6}};', '"') AS body FROM {step}""",
    r"""SELECT src, id, source, at,
      rtrim(regexp_replace(body, '( ?(\\.{{2,}}|…|\\[(\\.{{3}}|…)\\]|\\((\\.{{3}}|…)\\)|\\[\\+?[0-9]+ chars\\]))+$', '')) AS body,
      body rlike '(\\ufffd|[\\p{{L}}][-\\u2010]|<[^<>]*|&#?[a-zA-Z0-9]*|[\\(\\[][^()\\[\\]]*)$' AS broken FROM {step}""",
    # code and links are single words
    r"""SELECT src, id, source, at, broken, regexp_replace(regexp_replace(body, '`[^`]*`', ' ⓒ '), 'https?://[^\\s]+', ' ⓛ ') AS body FROM {step}""",
    # what follows the last finished sentence, and whether it is a list: many separators for its words
    r"""SELECT *, regexp_replace(body, '(?s)^.*[.!?]["”»’)]*[ ]', '') AS tail FROM {step}""",
    r"""SELECT *, regexp_count(tail, '[|·/,–&:(]') >= 3 AND regexp_count(tail, '[\\p{{L}}\\p{{N}}]+') <= 2 * (regexp_count(tail, '[|·/,–&:(]') + 1) AS listed FROM {step}""",
    r"""SELECT src, id, source, at, broken,
      CASE WHEN listed THEN concat(left(body, length(body) - length(tail)), regexp_replace(tail, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}.]*', 'ⓚ')) ELSE body END AS body FROM {step}""",
    # tokens stand between blanks
    r"""SELECT src, id, source, at, broken, concat('^ ^ ', trim(regexp_replace(regexp_replace(regexp_replace(body, '[0-9][0-9.,]*[0-9]|[0-9]', '0'),
      '[\\p{{L}}\\p{{M}}]+(?:[\'’-][\\p{{L}}]+)*|[^\\s]', ' $0 '), '[ ]+', ' '))) AS tokens FROM {step}""",
    r"""SELECT src, id, source, at, broken, tokens, regexp_replace(regexp_replace(regexp_replace(regexp_replace(tokens,
      '\\p{{Lu}}[\\p{{L}}\\p{{M}}]*(?:[\'’-][\\p{{L}}]+)*', 'A'), '\\p{{Ll}}[\\p{{L}}\\p{{M}}]*(?:[\'’-][\\p{{L}}]+)*', 'a'), '[\\p{{Lo}}\\p{{Lm}}\\p{{Lt}}][\\p{{L}}\\p{{M}}]*', 'o'), '\\s+', '') AS shape FROM {step}""",
    # the last trigram in words
    r"""SELECT src, id, source, at, broken, lower(tokens) AS tokens, shape, xxhash64(regexp_extract(lower(tokens), '([^ ]+ [^ ]+ [^ ]+)$', 1)) AS final FROM {step}""",
]

WORD_VERDICTS = """
SELECT f.final, f.f < {lift} * {chance} * c.n AS never_final
FROM (SELECT final, count(*) AS f FROM {shapes} GROUP BY final) f JOIN (SELECT trigram, count(*) AS n FROM {trigrams} GROUP BY trigram HAVING count(*) >= {least}) c ON f.final = c.trigram
"""

COUNTS = """
SELECT trigram, sum(n) - sum(f) AS inside, sum(f) AS final FROM (
  SELECT trigram, count(*) AS n, 0 AS f FROM (SELECT explode(regexp_extract_all(shape, '(?=(...))', 1)) AS trigram FROM {shapes}) GROUP BY trigram
  UNION ALL
  SELECT right(shape, 3) AS trigram, 0 AS n, count(*) AS f FROM {shapes} GROUP BY right(shape, 3)
) GROUP BY trigram
"""

VERDICTS = """
SELECT trigram,
  CASE WHEN inside + final >= {support} THEN final < {lift} * {chance} * (inside + final)
       WHEN inside2 + final2 >= {support} THEN final2 < {lift} * {chance} * (inside2 + final2)
       ELSE final1 < {lift} * {chance} * (inside1 + final1) END AS never_final
FROM (
  SELECT trigram, inside, final, sum(inside) OVER (PARTITION BY right(trigram, 2)) AS inside2, sum(final) OVER (PARTITION BY right(trigram, 2)) AS final2,
    sum(inside) OVER (PARTITION BY right(trigram, 1)) AS inside1, sum(final) OVER (PARTITION BY right(trigram, 1)) AS final1 FROM {counts}
) WHERE final > 0
"""

FLAGS = """
SELECT src, id, max_by(source, at) AS source, max_by(cut, at) AS cut FROM (
  SELECT e.src, e.id, e.source, coalesce(e.at, timestamp'1970-01-01') AS at, e.broken OR coalesce(w.never_final, false) OR coalesce(v.never_final, true) AS cut
  FROM {shapes} e LEFT JOIN {words} w ON e.final = w.final LEFT JOIN {verdicts} v ON right(e.shape, 3) = v.trigram
) GROUP BY src, id
"""


def texts_of(df: DataFrame, *, src: str, id_col: str, text: str, source: str, at: str) -> DataFrame:
    """The common form (src, id, source, at, body) of a table with possibly cut texts."""
    return df.where(F.col(id_col).isNotNull()).select(F.lit(src).alias("src"), F.col(id_col).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), F.col(at).cast("timestamp").alias("at"), F.col(text).alias("body"))


def cut_texts(texts: DataFrame, *, lift: float = LIFT, support: int = SUPPORT, frequent: float = FREQUENT) -> DataFrame:
    """(src, id, source, cut) of each text."""
    spark = texts.sparkSession
    shapes = texts
    for step in SHAPE_STEPS:
        shapes = spark.sql(step, step=shapes)
    shapes = cut(shapes)
    counts = cut(spark.sql(COUNTS, shapes=shapes))
    ends = counts.agg(F.sum("final").alias("final"), F.sum(F.col("inside") + F.col("final")).alias("total")).first()
    total = ends["total"] or 1
    settings = dict(support=support, lift=lift, chance=(ends["final"] or 0) / total)
    trigrams = spark.sql("SELECT xxhash64(words) AS trigram FROM (SELECT explode(regexp_extract_all(tokens, '(?=([^ ]+ [^ ]+ [^ ]+))[^ ]+ ', 1)) AS words FROM {shapes})", shapes=shapes)
    words = spark.sql(WORD_VERDICTS, shapes=shapes, trigrams=trigrams, least=max(support, math.ceil(frequent * total)), lift=lift, chance=settings["chance"])
    return spark.sql(FLAGS, shapes=shapes, words=words, verdicts=spark.sql(VERDICTS, counts=counts, **settings))


def cut_shares(flags: DataFrame) -> DataFrame:
    """(src, source, texts, cut_texts, share) of each provider or publisher."""
    return flags.sparkSession.sql("SELECT src, source, count(*) AS texts, count_if(cut) AS cut_texts, round(count_if(cut) / count(*), 6) AS share FROM {flags} GROUP BY src, source", flags=flags)
