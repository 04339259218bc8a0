"""Collocations by relational mining: sorted occurrence relations, merged with themselves word by word.

Texts are cut into pieces at punctuation and line ends, pieces into words. The
relation of level k holds one row per occurrence of a frequent phrase of k words:
``strip`` (its piece), ``pos`` (the place of its first word) and ``phrase`` (a
number). It is persisted, bucketed by ``strip`` and sorted by ``strip, pos``, so
that the next level needs no exchange of occurrences: merged with itself at the
adjacent position, it pairs every phrase with the one that starts a word later.
Both share all but their ends, so a pair is a phrase of k + 1 words, and its words
are frequent as far as they can be known. Pairs are grouped and counted (combined
before they are shuffled); groups that reach ``least`` get numbers; the pairs are
semi-joined with them, and that is the relation of the next level.

A word's number is a hash, by a seed that is seen to tell all words apart, so that no
occurrence has to meet the table of words; where that is small enough to be broadcast, it
takes out rare words early and gives shorter numbers. Frequent phrases are tables. One is broadcast only if its measured size is below
``BROADCAST_BYTES``, else both sides of the join with it are dealt by phrase, each task
holds its part as a hash table, and what was joined is dealt by ``strip`` again. A piece
longer than ``STRIP`` words is cut into strips that also hold the first words of the next
one; an occurrence counts in the strip that owns its first word, so long pieces count
exactly and spread.

A null text is empty, a null language ``und``; texts without words add nothing;
repeated rows count as often as they occur, whatever their ids; columns other than
text and language are not read. Ties in the score are broken by count, then by
phrase (bytes). An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortline.session import bucket_count, fresh_path, materialize

LONGEST, LEAST, TOP = 4, 30, 2000
STRIP, BROADCAST_BYTES = 1024, 64 << 20
PIECE_ENDS, BLANKS, BETWEEN = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+", r"[\x20\x09.,;:!?\x0A-\x0D]+"


def texts_of(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang`` and ``text``, nulls replaced."""
    return docs.select(F.coalesce(F.col(f"`{lang_column}`"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))


def lowered(word: Column) -> Column:
    """A-Z in lower case; ``lower`` does that faster where there is nothing else it could change."""
    changed = F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(changed)


def numbered(word: Column, seed: int) -> Column:
    """The number of a word of ``lang``."""
    return F.xxhash64(F.lit(seed), F.col("lang"), word)


def distinct_seed(counts: DataFrame, number: Callable[[Column, int], Column] = numbered) -> int:
    """The first seed by which all words ``lang, lower`` have numbers of their own."""
    seed = 0
    while True:
        n, numbers = counts.agg(F.count("*"), F.count_distinct(number(F.col("lower"), seed))).first()
        if n == numbers:
            return seed
        seed += 1


def strips_of(texts: DataFrame, overlap: int, strip: int) -> DataFrame:
    """Pieces, each of ``strip`` own words and up to ``overlap`` words of the next one, numbered: ``strip, lang, piece``.

    A piece of fewer than ``2 * strip`` characters has no more words, so only longer ones are looked into.
    """
    pieces = texts.select("lang", F.explode(F.split("text", PIECE_ENDS)).alias("piece"))
    pieces = pieces.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece != ''")
    words = F.split("piece", BLANKS)
    cut = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(strip)),
                      lambda start: F.array_join(F.slice(words, start + 1, F.lit(strip + overlap)), " "))
    strips = F.when(F.length("piece") < 2 * strip, F.array("piece")).otherwise(cut)
    return pieces.select("lang", F.explode(strips).alias("piece")).select(F.monotonically_increasing_id().alias("strip"), "lang", "piece")


def small_enough(table: DataFrame, row_bytes: Column, limit: int) -> bool:
    """Whether a written table, as a hash table in memory, stays below ``limit`` bytes."""
    return (table.agg(F.sum(row_bytes + 64)).first()[0] or 0) <= limit


class Relations:
    """Occurrence relations, persisted as bucketed tables until they are dropped."""

    def __init__(self, spark, buckets: int, limit: int):
        self.spark, self.buckets, self.limit, self.names = spark, buckets, limit, []

    def persist(self, rows: DataFrame) -> DataFrame:
        name = f"occurrences_{uuid.uuid4().hex}"
        self.names.append(name)
        (rows.select("strip", "pos", "phrase").write.format("parquet").bucketBy(self.buckets, "strip")
         .sortBy("strip", "pos").option("path", fresh_path(self.spark, "occurrences")).saveAsTable(name))
        return self.spark.table(name)

    def kept(self, pairs: DataFrame, frequent: DataFrame) -> DataFrame:
        """The pairs, dealt by ``strip``, that are frequent, with the number of what they hold."""
        if small_enough(frequent, F.lit(24), self.limit):
            return pairs.join(F.broadcast(frequent), ["p", "q"])
        return pairs.join(frequent.hint("shuffle_hash"), ["p", "q"]).repartition(self.buckets, "strip")

    def drop(self) -> None:
        """Forget the tables; their files stay in the shared folder like those of other stages."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def adjacent(relation: DataFrame) -> DataFrame:
    """The sorted relation merged with itself one position on: each phrase ``p`` with the phrase ``q`` a word later."""
    by_place = Window.partitionBy("strip").orderBy("pos")
    ahead = relation.select("strip", "pos", F.col("phrase").alias("p"), F.lead("phrase").over(by_place).alias("q"),
                            F.lead("pos").over(by_place).alias("next"))
    return ahead.where("next = pos + 1").drop("next")


def frequent_phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST,
                     least: int = LEAST, strip: int = STRIP, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (``lang, words, f``) of 1 to ``longest`` words, and ``n``, the number of words, per ``lang``."""
    if longest < 1 or least < 1:
        raise ValueError("phrases have at least one word and occur at least once")
    spark = docs.sparkSession
    texts = texts_of(docs, text_column, lang_column)
    words = texts.select("lang", F.explode(F.split("text", BETWEEN)).alias("word")).where("word != ''")
    counts = materialize(words.groupBy("lang", lowered(F.col("word")).alias("lower")).agg(F.count("*").alias("f")), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    seed = distinct_seed(counts)
    level = materialize(counts.where(F.col("f") >= least).select(
        F.monotonically_increasing_id().alias("phrase"), numbered(F.col("lower"), seed).alias("number"), "lang",
        F.array("lower").alias("words"), "f"), "phrases")
    found = level.select("lang", "words", "f")
    relations = Relations(spark, bucket_count(spark, 16), limit)
    strips = strips_of(texts, longest - 1, strip).repartition(relations.buckets, "strip")
    placed = strips.select("strip", "lang", F.posexplode(F.split("piece", BLANKS)).alias("pos", "word"))
    rows = placed.select("strip", "pos", numbered(lowered(F.col("word")), seed).alias("number"))
    if small_enough(level, F.lit(16), limit):
        # rare words only make pairs that are counted in vain, and numbers in order take less room
        rows = rows.join(F.broadcast(level.select("number", "phrase")), "number")
    else:
        level, rows = level.withColumn("phrase", F.col("number")), rows.withColumnRenamed("number", "phrase")
    for k in range(2, longest + 1):
        if level.isEmpty():
            break
        pairs = adjacent(relations.persist(rows))
        groups = pairs.where(F.col("pos") < strip).groupBy("p", "q").agg(F.count("*").alias("f")).where(F.col("f") >= least)
        first = level.select(F.col("phrase").alias("p"), "lang", F.col("words").alias("before"))
        last = level.select(F.col("phrase").alias("q"), F.element_at("words", -1).alias("word"))
        level = materialize(groups.join(first, "p").join(last, "q").select(
            F.monotonically_increasing_id().alias("phrase"), "p", "q", "lang", F.concat("before", F.array("word")).alias("words"), "f"),
            "phrases")
        found = found.unionByName(level.select("lang", "words", "f"))
        rows = relations.kept(pairs, level.select("p", "q", "phrase"))
    relations.drop()
    return found, totals


def scored(found: DataFrame) -> DataFrame:
    """Phrases of two words and more with the counts around their lowest-scoring cut: ``lang, words, phrase, a, l, r, score``."""
    named = found.select("lang", F.array_join("words", " ").alias("phrase"), "f")
    phrases = found.where(F.size("words") > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = phrases.select("*", cut.alias("k")).select(
        "*", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    sides = (cuts.join(named.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
             .join(named.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    sides = sides.withColumn("score", F.expr("cast((cast(a as decimal(20,0)) * 2000000) div cast(l + r as decimal(20,0)) as bigint)"))
    best = sides.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"),
                                               F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def within_longer(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Phrases of two words and more that lie inside a longer one, and the largest count of such a one."""
    size = F.size("words")
    spans = F.explode(F.expr("""filter(flatten(transform(sequence(2, size(words) - 1), w ->
        transform(sequence(1, size(words) - w + 1), s -> array_join(slice(words, s, w), ' ')))), x -> x is not null)"""))
    inner = found.where(size > 2).select("lang", spans.alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST,
                 least: int = LEAST, top: int = TOP, strip: int = STRIP, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The ``top`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``.

    The score of a cut is ``floor(2000000 a / (l + r))``, exactly, with the counts of the phrase and of the two sides;
    the lowest cut counts. A phrase inside a longer one that occurs at least 0.8 times as often is left out.
    """
    found, totals = frequent_phrases(docs, text_column, lang_column, longest, least, strip, limit)
    kept = scored(found).join(within_longer(found), ["lang", "phrase"], "left")
    kept = kept.where("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, ws FROM (
    SELECT lang, regexp_extract_all(part, '[^\x20\x09]+') AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
      FROM documents))
  WHERE len(ws) > 0),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS p FROM pieces),
f AS (
  SELECT lang, list_slice(ws, p, p + k - 1) AS words, count(*) AS f
  FROM places, range(1, 5) AS sizes(k) WHERE p + k - 1 <= len(ws)
  GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT lang, words, f AS a, unnest(range(1, len(words))) AS k FROM f WHERE len(words) > 1),
sides AS (
  SELECT c.lang, c.words, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.words = list_slice(c.words, 1, c.k)
  JOIN f y ON y.lang = c.lang AND y.words = list_slice(c.words, c.k + 1, len(c.words))),
best AS (
  SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inside AS (
  SELECT lang, list_slice(words, s, s + w - 1) AS words, max(f) AS longer
  FROM f, range(2, 4) AS widths(w), range(1, 4) AS starts(s)
  WHERE w < len(words) AND s + w - 1 <= len(words) GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.words = b.words
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""
