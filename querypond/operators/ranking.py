"""Lexical ranking, fusion and re-ranking, batched by query."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querypond import constants as K
from querypond.functions import signals
from querypond.functions.columns import once
from querypond.functions.dialect import SPARK
from querypond.runtime import parallelism

K1, B = 1.5, 0.75
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000
#: Scores and what they are summed from that a Python worker holds at once.
CELLS = 1_000_000


def tokens(text) -> F.Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def spread(docs: DataFrame, id_col: str, text: str, *keep: str) -> DataFrame:
    """(doc, kept columns, dl, term): one row a word; the length is taken before the words are spread. The outer generator is not
    preceded by a filter that would tokenize the text once more."""
    words = docs.select(F.col(id_col).alias("doc"), *keep, tokens(F.col(text)).alias("w"))
    return words.select("doc", *keep, F.size("w").alias("dl"), F.explode_outer("w").alias("term")).where("term IS NOT NULL")


def asked_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, term, times) of the queries' words."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def inverse_frequency(n, df) -> F.Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def saturated(weight, average) -> F.Column:
    """What a term adds to the score of a document with tf and dl."""
    return weight * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf, dl): one row a document and term."""
    return spread(docs, id_col, text).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(queries: DataFrame, docs: DataFrame, *, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, raw): scores of documents that hold a query term, statistics over all documents.

    Only words that some query has leave the scan. They are partitioned by document, which serves the term counts, the document
    frequencies and the sums, so a score is complete where it is made and a top-k cuts it before anything else moves. Repeated query
    terms count. The queries' words are broadcast if they are few, else joined by term.
    """
    stats = docs.select(F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    n, average = stats["n"], stats["avg"] or 1.0
    wanted = asked_terms(queries, query_id, query)
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)
    postings = spread(docs, doc_id, text).join(hint(wanted.select("term").distinct()), "term", "left_semi").repartition("doc").groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    # The lengths, which a document with a term always has, are read here only so that both branches are one exchange.
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.min("dl").alias("least")).where("least > 0").select("term", "df")
    idf = inverse_frequency(F.lit(float(n)), F.col("df"))
    weighted = wanted.join(df, "term").select("query_id", "term", (idf * F.col("times")).alias("weight"))
    return postings.join(hint(weighted), "term").groupBy("query_id", F.col("doc").alias("doc_id")).agg(F.sum(saturated(F.col("weight"), average)).alias("raw"))


def bm25_first(queries: DataFrame, groups: DataFrame, docs: DataFrame, k: int, *, group: str) -> DataFrame:
    """(query_id, group, doc_id, raw, place): of documents (doc_id, group, text), each once, the k best of each query in each of its
    groups (query_id, group), with statistics over all documents.

    Only scores that a query's groups ask for are made, of some documents at once, and all but a task's first k stay where they are
    made, so no task holds the words or scores of all its documents, whatever their number. Statistics, frequencies and scores read the
    same columns of the documents, so that these are one exchange where they come out of one by doc_id. Queries with more words than
    are broadcast at once are scored in further blocks, over the same documents.
    """
    wanted, groups = asked_terms(queries), groups.select("query_id", group).distinct()
    size = wanted.count()
    hint = F.broadcast if size <= BROADCAST_ROWS else (lambda df: df)
    # A group's length is never negative: the comparisons only keep the column.
    most, kept = F.max(F.length(group)).alias("most"), "coalesce(most, 0) >= 0"
    length = F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+"))
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg(length).alias("avg"), most).where(kept).select("n", F.coalesce(F.nullif("avg", F.lit(0.0)), F.lit(1.0)).alias("avg"))
    words = docs.select(group, F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term")).where("term IS NOT NULL")
    df = words.join(hint(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), most).where(kept)
    known = df.agg(F.collect_list(F.struct("term", "df")).alias("terms")).crossJoin(stats).select(F.struct("n", "avg", "terms").alias("known"))
    # The first row of a task brings the statistics. Documents without an id count in these only; a filter before the exchange would
    # make a second one of it.
    is_first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    told = docs.select("doc_id", group, tokens(F.col("text")).alias("w")).crossJoin(F.broadcast(known)).select("doc_id", group, "w", F.when(is_first, F.col("known")).alias("known"))
    schema = T.StructType([wanted.schema["query_id"], docs.schema[group], docs.schema["doc_id"], T.StructField("raw", T.DoubleType())])
    blocks = max(1, -(-size // BROADCAST_ROWS))
    some = lambda rows, b: (rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else rows).toArrow()
    scores = reduce(DataFrame.unionByName, [told.mapInArrow(_first_scores(some(wanted, b), some(groups, b), k, schema.names), schema) for b in range(blocks)])
    order = Window.partitionBy("query_id", group).orderBy(F.col("raw").desc(), "doc_id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _at(values, among: pa.Array) -> np.ndarray:
    """Positions of values in an array, -1 where they are not."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _first_scores(asked: pa.Table, groups: pa.Table, k: int, names: list[str]):
    """The function from a task's batches (doc, group, words, statistics) to its first k (query, group, doc, raw) of each query and
    group; asked: (query, term, times), groups: (query, group). Terms are summed in one order, so equal texts have equal scores."""
    asked = asked.filter(pc.is_valid(asked.column(0)))
    ids, terms = pc.unique(asked.column(0)), pc.unique(asked.column(1))
    terms = terms.take(pc.sort_indices(terms))
    query, term, times = _at(asked.column(0), ids), _at(asked.column(1), terms), asked.column(2).to_numpy()
    by_term = np.argsort(term, kind="stable")
    query, term, times = query[by_term], term[by_term], times[by_term]
    asks: dict[object, list[int]] = {}
    for name, q in zip(groups.column(1).to_pylist(), _at(groups.column(0), ids), strict=True):
        if name is not None and q >= 0:
            asks.setdefault(name, []).append(q)

    def weights(name) -> tuple[np.ndarray, ...]:
        """The queries of a group, and by term the places of those that have it, with their times."""
        own = np.array(asks[name])
        local = np.full(len(ids), -1)
        local[own] = np.arange(len(own))
        its = local[query] >= 0
        return own, np.searchsorted(term[its], np.arange(len(terms) + 1)), local[query[its]], times[its]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, average, of, kind = None, 1.0, {}, None
        for batch in batches:
            if not batch.num_rows or not len(terms):
                continue
            if idf is None:
                n, average, df = (batch.column(3).slice(0, 1).field(x) for x in ("n", "avg", "terms"))
                n, average, df, met = n[0].as_py(), average[0].as_py(), df.flatten(), np.zeros(len(terms))
                at = _at(df.field("term"), terms)
                met[at[at >= 0]] = df.field("df").to_numpy()[at >= 0]
                idf, kind = np.log((n - met + 0.5) / (met + 0.5) + 1.0), batch.column(1).type
            batch = batch.filter(pc.is_valid(batch.column(0)))
            dl = pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            t = _at(batch.column(2).flatten(), terms)
            cell, tf = np.unique((np.repeat(np.arange(len(dl)), dl) * len(terms) + t)[t >= 0], return_counts=True)
            d, t = np.divmod(cell, len(terms))
            part = idf[t] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl[d] / average))
            coded = batch.column(1).dictionary_encode()
            group = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)[d]
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(len(coded.dictionary) + 1))
            for g, name in enumerate(coded.dictionary.to_pylist()):
                if name in asks:
                    if name not in of:
                        w = weights(name)
                        of[name] = _Best(w, np.full(len(w[0]), np.finfo(float).tiny), batch.column(0).slice(0, 0))
                    at = order[edges[g] : edges[g + 1]]
                    of[name].add(d[at], t[at], part[at], batch.column(0), k)
        for name, best in of.items():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.own[best.query])), pa.array([name] * len(best.raw), kind), best.docs, pa.array(best.raw)], names=names)

    return find


class _Best:
    """The first k documents of each query of a group so far; least: the score that a further one needs."""

    def __init__(self, weights: tuple[np.ndarray, ...], least: np.ndarray, docs: pa.Array):
        self.own, self.start, self.column, self.times = weights
        self.least, self.docs, self.query, self.raw = least, docs, np.zeros(0, np.int64), np.zeros(0)

    def add(self, d: np.ndarray, t: np.ndarray, part: np.ndarray, docs: pa.Array, k: int) -> None:
        """Documents d, in order, with term t, which adds part to the score for each time that it is asked for."""
        times = self.start[t + 1] - self.start[t]
        d, t, part, times = (x[times > 0] for x in (d, t, part, times))
        if not len(d):
            return
        own, row = np.unique(d, return_inverse=True)
        chunk = (np.cumsum(np.bincount(row, times) + len(self.own)) // CELLS)[row]
        for some in np.split(np.arange(len(d)), np.flatnonzero(np.diff(chunk)) + 1):
            low, n = row[some[0]], row[some[-1]] - row[some[0]] + 1
            each, ends = times[some], np.cumsum(times[some])
            at = np.repeat(self.start[t[some]] - ends + each, each) + np.arange(ends[-1])
            raw = np.bincount(self.column[at] * n + np.repeat(row[some] - low, each), self.times[at] * np.repeat(part[some], each), len(self.own) * n).reshape(-1, n)
            if n > k:
                self.least = np.maximum(self.least, np.partition(raw, n - k, axis=1)[:, n - k])
            query, place = np.nonzero(raw >= self.least[:, None])
            if len(query):
                self._merge(query, raw[query, place], docs.take(pa.array(own[low + place])), k)

    def _merge(self, query: np.ndarray, raw: np.ndarray, docs: pa.Array, k: int) -> None:
        query, raw, docs = np.concatenate((self.query, query)), np.concatenate((self.raw, raw)), pa.concat_arrays([self.docs, docs])
        order = np.lexsort((pc.rank(docs, sort_keys="ascending").to_numpy(), -raw, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept, full = order[place < k], order[place == k - 1]
        self.least[query[full]] = raw[full]
        self.query, self.raw, self.docs = query[kept], raw[kept], docs.take(pa.array(kept))


#: Scores that are kept of each wanted one before they are rounded: those that rounding makes equal are ranked by document.
MARGIN = 4


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, **columns: str) -> DataFrame:
    """(query_id, doc_id, rank, bm25): the k best of each query, scores over the query's best, rounded to six digits. The best is among
    the first, so only these move."""
    raw = bm25(queries, docs, **columns).withColumn("_key", F.round("raw", 6))
    first = top_per_query(raw, MARGIN * k, "_key").drop("rank", "_key")
    return top_per_query(normalised(first).withColumn("bm25", F.round("bm25", 6)), k, "bm25").select("query_id", "doc_id", "rank", "bm25")


def top_per_query(scores: DataFrame, k: int, score: str, tie: str = "doc_id", query: str = "query_id") -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalised(scores: DataFrame, score: str = "raw", out: str = "bm25", query: str = "query_id") -> DataFrame:
    """Scores over the largest of their query."""
    top = F.max(score).over(Window.partitionBy(query))
    return scores.withColumn(out, F.when(top > 0, F.col(score) / top).otherwise(0.0))


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Of rows (query, list_id, item, rank): the fused score over the largest of the query."""
    summed = ranked.groupBy(query, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("raw"))
    return normalised(summed, "raw", "rrf", query).drop("raw")


def stuffing(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, stuffing): share of the most frequent token that is no stop word, over 15 %."""
    tf = term_frequencies(docs, id_col, text)
    top = tf.groupBy("doc").agg(F.max(F.when(~F.col("term").isin(*K.STUFFING_STOPWORDS), F.col("tf")).otherwise(0)).alias("top"), F.first("dl").alias("dl"))
    return top.select(F.col("doc").alias("id"), F.when(F.col("dl") < 20, 0.0).otherwise(F.least(F.col("top") / F.col("dl") / 0.15, F.lit(1.0))).alias("stuffing"))


def with_signals(candidates: DataFrame, *, text: str, stuffing_of: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, url, title, snippet, provider, author, published_at) with all signals that need no query."""
    if stuffing_of is not None:
        candidates = candidates.join(stuffing_of.withColumnRenamed("id", id_col), id_col, "left")
    base = candidates.withColumn("host", F.expr(signals.host(SPARK)))
    base = base.withColumn("raw_trust", F.expr(signals.trust())).withColumn("stuffing", F.coalesce("stuffing", F.lit(0.0)) if stuffing_of is not None else F.lit(0.0))
    rules = {
        "trust": signals.adjusted_trust(SPARK), "freshness": signals.freshness(SPARK), "popularity": signals.popularity(SPARK), "code_quality": signals.code_quality(SPARK), "has_examples": signals.has_examples(SPARK, text),
        "authority": signals.authority(SPARK, "raw_trust"), "source_quality": signals.source_quality(SPARK), "spam": signals.spam(SPARK, text, "stuffing", "raw_trust"), "ai_relevance": "0.5", "semantic": "0.5",
    }
    return base.withColumns({k: F.expr(v).cast("double") for k, v in rules.items()})


def scored(candidates: DataFrame, *, text: str, stuffing_of: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Candidates (query_id, doc_id, bm25, url, title, snippet, provider, author, published_at) with signals and final score."""
    return with_signals(candidates, text=text, stuffing_of=stuffing_of, id_col=id_col).withColumn("final_score", F.expr(signals.final_score()))


def concepts(text) -> F.Column:
    """Significant words and word pairs of a text."""
    stop = K.CONCEPT_STOPWORDS

    def of(words: F.Column) -> F.Column:
        single = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(F.get(words, i - 1).alias("a"), F.get(words, i).alias("b")))
        kept = F.filter(pairs, lambda p: p.b.isNotNull() & (F.length(p.a) + F.length(p.b) + 1 > 6) & ~p.a.isin(*stop))
        return F.array_distinct(F.concat(single, F.transform(kept, lambda p: F.concat(p.a, F.lit(" "), p.b))))

    return once(tokens(F.regexp_replace(text, "[-–—]", " ")), of)


def topic_alignment(query, title, snippet, provider) -> F.Column:
    """Share of the query's concepts that the text covers, with penalties for off-topic sources and hijacked names."""
    given = F.struct(query.alias("query"), F.lower(query).alias("low"), concepts(query).alias("asked"), F.concat(title, F.lit(" "), F.coalesce(snippet, F.lit(""))).alias("original"), provider.alias("provider"))

    def of(x: F.Column) -> F.Column:
        pair = lambda c: F.instr(c, " ") > 0
        # a word is covered as it is, without its plural s, or with one
        stands = lambda w: F.contains(x.words, F.concat(F.lit(" "), w, F.lit(" "))) & ~w.isin(*K.CONCEPT_STOPWORDS)
        singular = lambda w: F.endswith(w, F.lit("s")) & (F.length(w) > 3) & stands(F.substring(w, F.lit(1), F.length(w) - 1))
        met = F.size(F.filter(x.asked, lambda c: pair(c) & F.contains(x.doc, c)))
        covered = F.size(F.filter(x.asked, lambda c: ~pair(c) & (stands(c) | stands(F.concat(c, F.lit("s"))) | singular(c)))) + met
        off = F.lit(False)
        for source, terms in K.OFF_TOPIC_SOURCES.items():
            off = off | ((x.provider == source) & reduce(lambda a, b: a | b, [F.contains(x.low, F.lit(t)) for t in terms]))
        hijacked = F.exists(F.split(x.query, "[^A-Za-z0-9]+"), lambda w: (F.length(w) >= 3) & w.rlike(".[A-Z]") & F.contains(x.doc, F.lower(w)) & ~F.contains(x.original, w))
        pairs = F.filter(x.asked, pair)
        return F.struct((covered / F.size(x.asked)).alias("coverage"), F.size(pairs).alias("pairs"), met.alias("met"), F.greatest(F.when(off, 0.4).otherwise(0.0), F.when(hijacked, 0.3).otherwise(0.0)).alias("penalty"), F.size(x.asked).alias("n"))

    def score(m: F.Column) -> F.Column:
        overlap = F.when(m.pairs > 0, m.met / m.pairs).otherwise(m.coverage)
        return F.when(m.n == 0, 0.5).otherwise(F.least(m.coverage * 0.5 + overlap * 0.2 + (1 - m.penalty) * 0.3, F.lit(1.0)))

    there = lambda g: F.struct(g.query.alias("query"), g.low.alias("low"), g.asked.alias("asked"), g.original.alias("original"), g.provider.alias("provider"), F.lower(g.original).alias("doc"), F.concat(F.lit(" "), F.regexp_replace(F.lower(g.original), "[^a-z0-9]+", " "), F.lit(" ")).alias("words"))
    return once(once(once(given, there), of), score)


def rerank(ranked: DataFrame) -> DataFrame:
    """Rows (query_id, query, doc_id, title, snippet, provider, final_score) with alignment and the composite, 0 to 100."""
    top = F.greatest(F.max("final_score").over(Window.partitionBy("query_id")), F.lit(1.0))
    aligned = ranked.repartition(parallelism(ranked.sparkSession), "query_id", "doc_id" if "doc_id" in ranked.columns else "url").withColumn("alignment", topic_alignment(F.col("query"), F.col("title"), F.col("snippet"), F.col("provider")))
    return aligned.withColumn("rerank_score", F.floor(100 * (0.4 * F.col("final_score") / top + 0.6 * F.col("alignment")) + 0.5))
