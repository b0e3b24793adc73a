"""Passage ranking. README-only in the reference; formulas are ours
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casefile.functions.text import question_intent, tokens
from casefile.operators.groups import broadcast_within, fits
from casefile.operators.trace import RULES, agent_summary
from casefile.schemas import ISSUE
from casefile.sources.sinks import materialized

K1 = 1.2
B = 0.75
FUSION_OFFSET = 60
TOP_K = 10
# Passages of a documentation answer, and the digits of a bigint in a unit's key.
ANSWER_PASSAGES = 3
UNIT_DIGITS = 19
Small = Callable[[DataFrame], DataFrame]
# Rare tokens of a question are taken until their lists hold so many times k rows.
PROBE_DOCUMENTS = 4
SLACK = 2e-6
# Idle tokens may reach this share of the threshold: the smaller it is, the more
# rows are added up before the pruning, and the fewer are completed after it.
IDLE_SHARE = 0.5
# Beyond this size the query side is not broadcast.
MAX_BROADCAST_TOKENS = 500_000
# Questions and vector elements of passages in one cell of the grid.
MAX_BLOCK_QUERIES = 8192
MAX_CELL_NUMBERS = 1 << 23
# Questions whose scores against one cell are held at the same time.
SCORED_AT_ONCE = 256
# (document, token, question) triples that a task of the lexical search adds up at once.
TRIPLES_AT_ONCE = 1 << 20


def top_k(scored: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The ``k`` best items of each query; ties go to the smaller item. Spark
    cuts each query to ``k`` rows within every task before it shuffles."""
    order = W.partitionBy(query).orderBy(F.desc("score"), item)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    rank = F.col("rank").cast("bigint").alias("rank")
    return ranked.where(F.col("rank") <= k).select(query, item, rank)


def token_counts(documents: DataFrame, vocabulary: DataFrame, item: str) -> DataFrame:
    """(item, token, tf, n_words) of every document and each token of
    ``vocabulary`` in it, and one row with the token '' for the document itself.

    One pass over the texts: a document's tokens are cut to the vocabulary and
    counted before the shuffle by (document, token), so only matched rows move.
    """
    words = documents.select(item, tokens(F.col("text")).alias("words"))
    listed = F.concat(F.array(F.lit("")), F.coalesce("words", F.array().cast("array<string>")))
    corpus = words.select(item, F.size("words").alias("n_words"), F.explode(listed).alias("token"))
    whole = documents.sparkSession.range(1).select(F.lit("").alias("token"))
    kept = corpus.join(vocabulary.unionByName(whole), "token", "left_semi")
    return kept.groupBy(item, "token").agg(
        F.count(F.lit(1)).alias("tf"), F.max("n_words").alias("n_words")
    )


def impacts(counts: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """(item, token, block, part): what a token adds to the BM25 score of a document,
    but for its idf. A block holds the documents of like length, from a power of two
    words to the next. And (token, block, df, idf, most): in how many documents the
    token is, its idf, and the most that it adds to a score in the block."""
    size = F.struct(F.count(F.lit(1)).alias("total"), F.avg("n_words").alias("average"))
    whole = counts.where("token = ''").groupBy().agg(size.alias("size"))
    total, average = whole.scalar()["total"], whole.scalar()["average"]
    length_norm = K1 * (1 - B + B * F.col("n_words") / average)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + length_norm)
    block = F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")
    table = counts.where("token <> ''").select(item, "token", block.alias("block"), part.alias("part"))
    blocks = table.groupBy("token", "block").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("most"))
    df = F.col("df")
    weighted = blocks.withColumn("df", F.sum("n").over(W.partitionBy("token"))).withColumn(
        "idf", F.log(1 + (total - df + 0.5) / (df + 0.5))
    )
    return table, weighted.select("token", "block", "df", "idf", (F.col("idf") * F.col("most")).alias("most"))


def asked_tokens(questions: DataFrame, query: str) -> DataFrame:
    """(question, token) of the distinct tokens of each question."""
    return questions.select(query, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))


def bounded_scores(
    postings: DataFrame, terms: DataFrame, query: str, item: str, k: int, small: Small = F.broadcast
) -> tuple[DataFrame, DataFrame]:
    """Scores of the documents that can be among the ``k`` best of a question, and
    the (question, document, partial) rows that were added up to find them.
    ``terms`` has the questions' tokens with their bounds by block.

    Exact, by bounds on scores. Each question's rarest tokens find ``k`` documents,
    whose full scores give a threshold that the ``k`` best reach. In a block, tokens
    that together cannot reach the threshold are idle: a document of the block with
    no other token of the question cannot be among the best and is never looked at,
    so the long lists of common tokens are not expanded, and blocks in which all
    tokens are idle are skipped. Of the others, those stay whose part from the other
    tokens and the bound of the idle ones reach the threshold; only for them the idle
    tokens are looked up, by (document, token). A question that fewer than ``k``
    documents match has no threshold and is scored in full. ``small`` marks
    question-side tables for broadcast where their size allows it.
    """
    asked = terms.groupBy(query, "token").agg(F.max("df").alias("df"), F.max("idf").alias("idf"))
    rarest = W.partitionBy(query).orderBy("df", "token").rowsBetween(W.unboundedPreceding, -1)
    asked = asked.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0)))
    impact = (F.col("idf") * F.col("part")).alias("partial")

    def completed(found: DataFrame, rest: DataFrame, keys: list[str], few: bool) -> DataFrame:
        """Adds what the tokens ``rest`` of their question bring to each pair: with few
        pairs by looking each token up, else by cutting the tokens' rows to the pairs."""
        if few:
            probes = F.broadcast(found.join(small(rest), keys).select(query, item, "token", "idf"))
            more = postings.join(probes, [item, "token"]).select(query, item, impact)
        else:
            on = ["token", *(c for c in keys if c != query)]
            rows = postings.join(small(rest), on).select(query, item, impact)
            more = rows.join(found.select(query, item), [query, item], "left_semi")
        both = found.select(query, item, "partial").unionByName(more)
        return both.groupBy(query, item).agg(F.sum("partial").alias("partial"))

    probing = F.col("before") < PROBE_DOCUMENTS * k
    order = W.partitionBy(query).orderBy(F.desc("partial"), item)
    rare = asked.where(probing).select(query, "token", "idf")
    first = postings.join(small(rare), "token").select(query, item, impact)
    first = first.groupBy(query, item).agg(F.sum("partial").alias("partial"))
    first = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    reached = completed(
        first, asked.where(~probing).select(query, "token", "idf"), [query], fits(asked, MAX_BROADCAST_TOKENS // k)
    )
    least = F.when(F.count(F.lit(1)) >= k, F.min("partial"))
    thresholds = reached.groupBy(query).agg(least.alias("threshold")).where("threshold IS NOT NULL")

    weakest = W.partitionBy(query, "block").orderBy("most", "token").rowsBetween(W.unboundedPreceding, 0)
    judged = terms.join(thresholds, query, "left").withColumn("upto", F.sum("most").over(weakest))
    # Scores are compared after rounding to six places.
    judged = judged.withColumn("idle", F.coalesce(F.col("upto") < IDLE_SHARE * F.col("threshold") - SLACK, F.lit(False)))
    rest = F.coalesce(F.max(F.when(F.col("idle"), F.col("upto"))).over(W.partitionBy(query, "block")), F.lit(0.0))
    judged = materialized(judged.withColumn("rest", rest), "judged-terms")
    chosen = judged.where("NOT idle").select(query, "token", "block", "idf", "threshold", "rest")
    matched = postings.join(small(chosen), ["token", "block"])
    partial = matched.groupBy(query, item, "block").agg(
        F.sum(F.col("idf") * F.col("part")).alias("partial"), F.max("threshold").alias("threshold"), F.max("rest").alias("rest")
    )
    able = F.col("partial") + F.col("rest") >= F.col("threshold") - SLACK
    kept = partial.where(F.col("threshold").isNull() | able)
    kept = materialized(kept.select(query, item, "block", "partial"), "candidates")
    idle = judged.where("idle").select(query, "token", "block", "idf")
    few = fits(kept.join(idle, [query, "block"]), MAX_BROADCAST_TOKENS)
    full = completed(kept, idle, [query, "block"], few)
    return full.select(query, item, F.round("partial", 6).alias("score")), partial


def _packed(item: str, known: pa.Array):
    """A map from (item, words) to one row per document: its number of words, and the
    numbers of the tokens of ``known`` in it with how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            number = pc.index_in(words.flatten(), value_set=known).to_numpy(zero_copy_only=False)
            found = ~np.isnan(number) if number.dtype.kind == "f" else np.ones(len(number), bool)
            row = pc.list_parent_indices(words).to_numpy().astype(np.int64)[found]
            pairs, counts = np.unique(row * len(known) + number[found].astype(np.int64), return_counts=True)
            row, token = np.divmod(pairs, max(1, len(known)))
            starts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            sizes = pc.fill_null(pc.list_value_length(words), 0).cast(pa.int64())
            lists = [pa.ListArray.from_arrays(starts, pa.array(c.astype(np.int32))) for c in (token, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *lists], names=[item, "n_words", "tokens", "counts"])

    return run


def packed_documents(documents: DataFrame, known: pa.Array, item: str) -> DataFrame:
    """(item, n_words, tokens, counts) of every document, written. One narrow pass over
    the texts; only rows whose item is there more than once are shuffled, to be added up."""
    words = documents.select(item, F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    kind = documents.schema[item].dataType.simpleString()
    schema = f"`{item}` {kind}, n_words bigint, tokens array<int>, counts array<int>"
    stored = materialized(words.mapInArrow(_packed(item, known), schema), "postings")
    mark = F.xxhash64(item).alias("mark")
    repeated = stored.groupBy(mark).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("mark")
    repeated = materialized(repeated, "repeated")
    if repeated.isEmpty():
        return stored
    marked = stored.select("*", mark)
    again = marked.join(repeated, "mark", "left_semi")
    listed = again.select(item, "n_words", F.explode_outer(F.arrays_zip("tokens", "counts")).alias("of"))
    added = listed.groupBy(item, "of.tokens").agg(F.sum("of.counts").cast("int").alias("tf"), F.max("n_words").alias("n_words"))
    # A row without tokens keeps its document; there are at most as many tokens as asked for.
    entry = F.when(F.col("tokens").isNotNull(), F.struct("tokens", "tf"))
    whole = added.groupBy(item).agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_list(entry)).alias("of"))
    whole = whole.select(item, "n_words", F.col("of.tokens").alias("tokens"), F.col("of.tf").alias("counts"))
    return materialized(marked.join(repeated, "mark", "left_anti").drop("mark").unionByName(whole), "postings")


def _best_documents(query: str, item: str, k: int, average: float, ids: pa.Array, asked: tuple[np.ndarray, ...]):
    """A map from packed documents to the ``k`` best of the task per question, with
    their scores. ``asked`` has, by token, where its questions start among the
    following, how many there are, and its idf; then the questions."""
    start, many, idf, questions = asked

    def triples(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``token``, that place once per question with the token."""
        times = many[token]
        place = np.repeat(np.arange(len(token)), times)
        within = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        return place, questions[start[token[place]] + within]

    def cut(found: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = [("question", "ascending"), ("score", "descending"), (item, "ascending")]
        found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_start"))
        question = found.column("question").to_numpy()
        place = np.arange(len(question)) - np.searchsorted(question, question)
        floor = np.full(len(ids), -np.inf)
        floor[question[place == k - 1]] = found.column("score").to_numpy()[place == k - 1]
        return found.filter(pa.array(place < k)), floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = None, np.full(len(ids), -np.inf)
        for batch in batches:
            token = batch.column(2).flatten().to_numpy()
            tf = batch.column(3).flatten().to_numpy()
            row = pc.list_parent_indices(batch.column(2)).to_numpy().astype(np.int64)
            norm = K1 * (1 - B + B * batch.column(1).to_numpy() / average)
            part = idf[token] * (tf * (K1 + 1) / (tf + norm[row]))
            # Slices end where a document does.
            upto = np.concatenate(([0], np.cumsum(many[token])))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            at = 0
            while at < batch.num_rows:
                limit = upto[ends[at]] + TRIPLES_AT_ONCE
                to = max(at + 1, int(np.searchsorted(upto[ends], limit, side="right")) - 1)
                here = slice(ends[at], ends[to])
                place, question = triples(token[here])
                pair = (row[here][place] - at) * len(ids) + question
                if (to - at) * len(ids) <= 8 * len(pair):
                    scores = np.bincount(pair, part[here][place], minlength=0)
                    pair = np.flatnonzero(scores)
                    scores = scores[pair]
                else:
                    pair, same = np.unique(pair, return_inverse=True)
                    scores = np.bincount(same, part[here][place], minlength=len(pair))
                doc, question = np.divmod(pair, len(ids))
                scores = np.round(scores, 6)
                able = scores >= floor[question]
                if able.any():
                    found = [pa.array(question[able]), batch.column(0).take(pa.array(doc[able] + at)), pa.array(scores[able])]
                    more = pa.Table.from_arrays(found, names=["question", item, "score"])
                    best, floor = cut(more if best is None else pa.concat_tables([best, more]))
                at = to
        if best is not None:
            columns = [ids.take(best.column("question").combine_chunks()), best.column(item), best.column("score")]
            yield from pa.Table.from_arrays(columns, names=[query, item, "score"]).combine_chunks().to_batches()

    return run


def scanned_scores(documents: DataFrame, asked: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Scores of the documents that are among the ``k`` best of a question within their
    task, so all of the ``k`` best. ``asked`` are the distinct (question, token) rows,
    few enough to be broadcast.

    Two narrow passes: the first counts each document's tokens, cut to those asked for,
    and writes them; the second adds up the scores of a batch of documents for all
    questions and keeps ``k`` per question. Neither postings nor pairs are shuffled.
    """
    table = asked.toArrow()
    known = pc.unique(table.column("token"))
    ids = pc.unique(table.column(query))
    stored = packed_documents(documents, known, item)
    size = stored.agg(F.count(F.lit(1)).alias("total"), F.avg("n_words").alias("average")).first()
    counted = stored.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(known))
    df[counted.column("token").to_numpy()] = counted.column("df").to_numpy()
    idf = np.log(1 + (size["total"] - df + 0.5) / (df + 0.5))
    token = pc.index_in(table.column("token"), value_set=known).to_numpy()
    question = pc.index_in(table.column(query), value_set=ids).to_numpy()
    order = np.lexsort((question, token))
    many = np.bincount(token, minlength=len(known))
    terms = (np.cumsum(many) - many, many, idf, question[order].astype(np.int64))
    kinds = asked.schema[query].dataType.simpleString(), documents.schema[item].dataType.simpleString()
    schema = f"`{query}` {kinds[0]}, `{item}` {kinds[1]}, score double"
    return stored.mapInArrow(_best_documents(query, item, k, size["average"] or 1.0, ids, terms), schema)


def lexical_top_k(
    documents: DataFrame,
    questions: DataFrame,
    query: str = "item_id",
    item: str = "doc_id",
    k: int = TOP_K,
) -> DataFrame:
    """RET-1, SRT-4: the ``k`` documents with the highest BM25 score per question.

    Questions of up to ``MAX_BROADCAST_TOKENS`` tokens together are scored where the
    documents lie; beyond that, documents and questions meet by joins with bounds.
    """
    asked = asked_tokens(questions, query).distinct()
    if fits(asked, MAX_BROADCAST_TOKENS):
        return top_k(scanned_scores(documents, asked, query, item, k), query, item, k)
    # The list of postings is read several times, the texts once.
    counts = materialized(token_counts(documents, asked.select("token").distinct(), item), "postings")
    postings, bounds = impacts(counts, item)
    terms = materialized(asked.join(bounds, "token"), "terms")
    scored, _ = bounded_scores(postings, terms, query, item, k, lambda side: side)
    return top_k(scored, query, item, k)


def _best_of_cell(query: str, item: str, k: int):
    """A map over the passages and the questions of a cell that keeps the ``k``
    best items per query."""

    def matrix(table: pa.Table, ids: str) -> tuple[np.ndarray, np.ndarray]:
        names = table.column(ids).to_numpy()
        values = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return names.astype(np.int64), values.astype(np.float64).reshape(len(names), -1)

    def run(passages: pa.Table, questions: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if passages.num_rows and questions.num_rows:
            items, vectors = matrix(passages, item)
            asked, wanted = matrix(questions, query)
            for start in range(0, len(asked), SCORED_AT_ONCE):
                ids = asked[start : start + SCORED_AT_ONCE]
                scores = np.round(wanted[start : start + SCORED_AT_ONCE] @ vectors.T, 6)
                scores[(ids[:, None] == items[None, :]) | ~np.isfinite(scores)] = -np.inf
                cut = max(len(items) - k, 0)
                floor = np.partition(scores, cut, axis=1)[:, cut]
                rows, columns = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
                # Ties beyond the k-th go by the smaller id.
                order = np.lexsort((items[columns], -scores[rows, columns], rows))
                rows, columns = rows[order], columns[order]
                best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                rows, columns = rows[best], columns[best]
                found.append((ids[rows], items[columns], scores[rows, columns]))
        columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
        return pa.Table.from_arrays(columns, names=[query, item, "score"])

    return run


def _sizes(vectors: DataFrame) -> Column:
    """A map from width to the number of vectors, as a value within the plan."""
    counts = vectors.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("width", "n")))
    return counts.groupBy().agg(entries.alias("sizes")).scalar()


def vector_top_k(
    passages: DataFrame,
    questions: DataFrame,
    query: str = "item_id",
    item: str = "vec_id",
    k: int = TOP_K,
    block_queries: int = MAX_BLOCK_QUERIES,
    cell_numbers: int = MAX_CELL_NUMBERS,
) -> DataFrame:
    """RET-2, SRT-4: the passages with the largest dot product per question,
    never the one with the question's own id.

    A product of blocks on a grid: questions are dealt by hash to blocks of about
    ``block_queries``, passages to chunks of about ``cell_numbers`` vector elements,
    and a cell of the grid multiplies one block with one chunk. Both sides meet by an
    equi-join on the cell, a chunk is sent once per block, and a cell emits ``k``
    rows per question, so pairs are never rows. Vectors meet those of their own
    width; ``vector_widths`` tells which widths have no partner. Null vectors and
    vectors with null or non-finite elements match nothing. Nothing runs before the
    result is asked for, and the driver sees no vector.
    """
    asked = questions.where(F.col("embedding").isNotNull()).select(query, "embedding")
    stored = passages.where(F.col("embedding").isNotNull()).select(item, "embedding")
    width = F.size("embedding")
    n_asked = F.try_element_at(_sizes(asked), width)
    n_stored = F.try_element_at(_sizes(stored), width)
    blocks = F.ceil(n_asked / F.lit(block_queries))
    chunks = F.ceil(n_stored * F.greatest(width, F.lit(1)) / F.lit(cell_numbers))

    def dealt(rows: DataFrame, own: str, parts: Column, other: str, copies: Column) -> DataFrame:
        part = F.pmod(F.xxhash64(rows.columns[0], "embedding"), F.col("own")).alias(own)
        counted = rows.select("*", width.alias("width"), parts.alias("own"), copies.alias("copies"))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias(other)
        both = counted.where("own IS NOT NULL AND copies IS NOT NULL")
        return both.select(*rows.columns, "width", part, every)

    cells = ["width", "block", "chunk"]
    left = dealt(stored, "chunk", chunks, "block", blocks).groupBy(*cells)
    right = dealt(asked, "block", blocks, "chunk", chunks).groupBy(*cells)
    schema = f"{query} bigint, {item} bigint, score double"
    scored = left.cogroup(right).applyInArrow(_best_of_cell(query, item, k), schema)
    return top_k(scored, query, item, k)


def vector_widths(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(width, n_passages, n_questions) of every vector width of either side; a width
    with a zero has no partner and is in no result. Null vectors have width -1."""
    width = F.coalesce(F.size("embedding"), F.lit(-1)).cast("bigint").alias("width")
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    both = passages.select(width, one.alias("p"), zero.alias("q")).unionByName(
        questions.select(width, zero.alias("p"), one.alias("q"))
    )
    return both.groupBy("width").agg(F.sum("p").alias("n_passages"), F.sum("q").alias("n_questions"))


def fuse(
    lexical: DataFrame,
    vector: DataFrame,
    query: str = "item_id",
    item: str = "doc_id",
    k: int = TOP_K,
) -> DataFrame:
    """RET-3: reciprocal-rank fusion of two ranked lists."""
    left = lexical.withColumnRenamed("rank", "lexical_rank")
    right = vector.withColumnRenamed("rank", "vector_rank")

    def share(rank: str) -> Column:
        return F.coalesce(1 / (FUSION_OFFSET + F.col(rank)), F.lit(0.0))

    both = left.join(right, [query, item], "full")
    scored = both.withColumn(
        "score", F.round(share("lexical_rank") + share("vector_rank"), 9)
    )
    order = W.partitionBy(query).orderBy(F.desc("score"), item)
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            query,
            item,
            "lexical_rank",
            "vector_rank",
            F.col("rank").cast("bigint").alias("rank"),
        )
    )


def cited(ranked: DataFrame, documents: DataFrame, item: str = "doc_id") -> DataFrame:
    """ING-3: ranked passages with the source to cite."""
    return ranked.join(documents.select(item, "source"), item, "left")


def section_top_k(units: DataFrame, questions: DataFrame, query: str = "item_id", k: int = ANSWER_PASSAGES) -> DataFrame:
    """RET-1, ING-3: the ``k`` units of text, of documents and pages alike, with the
    highest BM25 score per question, each with where it stands. ``units`` have kind,
    doc_id, source, unit_no and unit; (kind, doc_id, unit_no) is their key, and ties go
    by it, with ids and numbers of at least 0 in their order.

    The units are cut out of their texts once and written; the texts of the chosen
    ones, at most ``k`` per question, are fetched by a join that broadcasts the chosen
    ones behind a check of their number.
    """
    def padded(name: str) -> Column:
        return F.lpad(F.col(name).cast("string"), UNIT_DIGITS, "0")

    key = F.concat_ws(":", "kind", padded("doc_id"), padded("unit_no")).alias("unit_key")
    named = units.select(key, "kind", "doc_id", "source", "unit_no", F.col("unit").alias("text"))
    stored = materialized(named, "units")
    best = materialized(lexical_top_k(stored, questions, query, "unit_key", k), "best-units")
    best = broadcast_within(best, best, MAX_BROADCAST_TOKENS)
    found = stored.join(best, "unit_key")
    return found.select(query, "rank", "kind", "doc_id", "source", "unit_no", F.col("text").alias("unit"))


def documentation_answers(questions: DataFrame, passages: DataFrame, query: str = "item_id") -> DataFrame:
    """RET-5, RET-3, RET-4: the documentation agent's answer to each question: its
    intent, the sentence that opens it, the passages found as its story, the distinct
    sources in the order of rank, and for each passage where it stands. A question that
    nothing matches keeps an empty story. ``passages`` are those of ``section_top_k``,
    a few per question."""
    entry = F.struct("rank", "kind", "doc_id", "source", "unit_no", "unit")
    gathered = passages.groupBy(query).agg(F.sort_array(F.collect_list(entry)).alias("found"))
    joined = questions.select(query, F.col("text").alias("question")).join(gathered, query, "left")
    none = F.array().cast(gathered.schema["found"].dataType)
    found = joined.withColumn("found", F.coalesce("found", none))

    def reference(passage: Column) -> Column:
        source = F.coalesce(passage["source"], F.lit("")).alias("source")
        return F.struct(source, F.lit(None).cast("int").alias("page"))

    return found.select(
        query,
        F.lit("documentation").alias("agent"),
        question_intent(F.coalesce("question", F.lit(""))).alias("intent"),
        F.struct(
            agent_summary(F.lit("documentation"), F.coalesce("question", F.lit(""))).alias("summary"),
            F.transform("found", lambda p: p["unit"]).alias("story"),
            F.array().cast(f"array<{ISSUE}>").alias("issues"),
            F.array().cast("array<string>").alias("recommendations"),
            F.array_distinct(F.transform("found", reference)).alias("references"),
        ).alias("answer"),
        F.transform("found", lambda p: F.struct(p["kind"], p["doc_id"], p["unit_no"])).alias("citations"),
    )


def rule_evidence(documents: DataFrame) -> DataFrame:
    """(rule, doc_id, source): the document that best matches each fixed rule."""
    rules = rule_questions(documents.sparkSession)
    best = lexical_top_k(documents, rules, "rule", "doc_id", 1)
    return cited(best, documents).select("rule", "doc_id", "source")


def rule_questions(spark: SparkSession) -> DataFrame:
    """The fixed trace rules as questions to the documentation."""
    rows = [(rule[0], rule[2]) for rule in RULES]
    return spark.createDataFrame(rows, "rule string, text string")


def anomaly_evidence(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """JON-9: each inconsistency with the passage that best matches its rule.
    There is one passage per rule, so that side is broadcast."""
    return issues.join(F.broadcast(rule_evidence(documents)), "rule", "left")
