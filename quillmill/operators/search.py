"""Lexical, vector and hybrid search over chunks, and the index they share.

The index is tables: chunks, postings (term, chunk, tf), document frequencies and vectors. Queries are a table too:
any number of them is answered in one plan, each against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.functions import vectors as V
from quillmill.session import batch_udf, written

#: Fusion constant, window and overlap in words, least new words of a snapped window, snippet words.
RRF_K, WINDOW, OVERLAP, SNAP, SNIPPET = 60, 200, 40, 80, 30
#: Published Okapi defaults.
K1, B = 1.2, 0.75
#: Queries that a task answers at once, at most; rows in one shard of an index; candidates scored at once.
QUERY_BLOCK, SHARD_ROWS, CANDIDATES = 2048, 16_384, 32_768
#: A term in at least one of so many chunks of a shard has a row over all of them.
DENSE = 64


def sentence_starts(words: list[str]) -> list[int]:
    """Numbers of the words that start a sentence: after a stop, with a capital."""
    return [i for i in range(1, len(words)) if words[i - 1].rstrip("\"'”’)]}»")[-1:] in (".", "!", "?") and words[i][:1].isupper()]


def window_spans(words: list[str], window: int = WINDOW, overlap: int = OVERLAP, snap: int = SNAP) -> list[tuple[int, int]]:
    """Overlapping windows; each but the last ends at the last sentence start in its far part, if there is one."""
    n, start, out = len(words), 0, []
    starts = sentence_starts(words) if n > window else []
    while start < n:
        end = min(start + window, n)
        if end < n:
            fit = [b for b in starts if start + overlap + snap < b <= end]
            end = fit[-1] if fit else end
        out.append((start, end))
        if end >= n:
            break
        start = end - overlap
    return out


def windows(c: Column | str, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """``array<string>``: windows of a text, words joined by single spaces; empty for null or blank text."""

    @batch_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            words = (t or "").split()
            return [" ".join(words[a:b]) for a, b in window_spans(words, window, overlap)]

        return texts.map(one)

    return run(X.col(c))


def chunk_pages(pages: DataFrame, doc: str = "doc_hash", page: str = "page", text: str = "text") -> DataFrame:
    """``(doc, page, idx, text)``: windows of every page, ``idx`` running over the document's pages from 0.

    The running index adds up the pages' counts; the texts are not shuffled together.
    """
    cut_up = pages.select(doc, page, windows(text).alias("w"))
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    based = cut_up.withColumn("base", F.coalesce(F.sum(F.size("w")).over(w), F.lit(0)))
    return based.select(doc, page, "base", F.posexplode("w").alias("p", "chunk")).select(doc, page, (F.col("base") + F.col("p")).cast("int").alias("idx"), F.col("chunk").alias("text"))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(key, term, tf, len)``; counted before the shuffle."""
    terms = chunks.select(key, X.fts_terms(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    return terms.select(key, F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, key, score)`` of all chunks that hold a query term; ``queries``: (query_id, query).

    Only the postings of query terms are shuffled. Document frequencies and mean length are over all chunks.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(X.fts_terms("query"))).alias("term"))
    wanted = terms.select("term").distinct()
    sized = chunks.select(key, X.fts_terms(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avg_len"))
    hits = sized.select(key, F.size("ts").alias("len"), F.explode("ts").alias("term")).join(wanted, "term", "left_semi").groupBy(key, "term", "len").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    # One row of statistics: its size does not depend on the data.
    x = hits.join(df, "term").join(terms, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return x.groupBy("query_id", key).agg(F.sum(part).alias("score"))


class _Best:
    """The k best rows of each of n queries so far; equal scores, rounded to ``digits``, go by key."""

    def __init__(self, n: int, k: int, digits: int):
        import numpy as np

        #: The score that a further row of a query must reach, minus infinity below k rows; as of the last ``settle``.
        self.least = np.full(n, -np.inf)
        self.k, self.digits, self.parts, self.new = k, digits, [], 0

    def add(self, q: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        """Takes in candidates."""
        import numpy as np

        self.parts.append((q, key, score, np.round(score, self.digits)))
        self.new += len(q)
        if self.new > 8 * CANDIDATES:
            self.settle()

    def settle(self) -> None:
        """Drops all but the k best of each query."""
        import numpy as np

        if not self.new:
            return
        q, key, score, by = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((key, -by, q))
        q, key, score, by = q[order], key[order], score[order], by[order]
        first = np.r_[True, q[1:] != q[:-1]]
        rank = np.arange(len(q)) - np.flatnonzero(first)[first.cumsum() - 1] + 1
        self.least[q[rank == self.k]] = by[rank == self.k]
        keep = rank <= self.k
        self.rank, self.parts, self.new = rank[keep], [(q[keep], key[keep], score[keep], by[keep])], 0

    def batches(self, ids: pa.Array, kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
        self.settle()
        if self.parts:
            q, key, score, by = self.parts[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(key).cast(kind), pa.array(score, pa.float64()), pa.array(by, pa.float64()), pa.array(self.rank.astype("int32"))], names=names)


def _gathered(rows: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """Calls ``rows`` for every ``SHARD_ROWS`` rows of a partition, and for its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for big in batches:
            for lo in range(0, big.num_rows, SHARD_ROWS):
                b = big.slice(lo, SHARD_ROWS)
                if n + b.num_rows > SHARD_ROWS:
                    yield rows(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
                held.append(b)
                n += b.num_rows
        if n:
            yield rows(pa.Table.from_batches(held).combine_chunks())

    return run


def _shards(folder: str, columns: list[str], part: int = 0, parts: int = 1) -> Iterator[dict]:
    """The shards in every ``parts``-th file of a folder of Parquet, one at a time."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    at, path = fs.FileSystem.from_uri(folder)
    for f in sorted(x.path for x in at.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))[part::parts]:
        with at.open_input_file(f) as source:
            for b in pq.ParquetFile(source).iter_batches(batch_size=1, columns=columns):
                for i in range(b.num_rows):
                    yield {c: b.column(c)[i] for c in columns}


def _searched(index: DataFrame, asked: DataFrame, k: int, key: str, kinds: tuple[str, str], search: Callable) -> DataFrame:
    """``(query_key, key, score, rank)`` by ``search(folder, part, parts)``, a function over batches of queries.

    The queries are spread over the tasks, about ``QUERY_BLOCK`` to each, and each task goes through the shards of the
    index. Few queries go to several tasks, which share the shards out.
    """
    name = asked.columns[0]
    folder = index.inputFiles()
    blocks = -(-asked.count() // QUERY_BLOCK)
    schema = f"{name} {kinds[0]}, {key} {kinds[1]}, score double, by double, rank int"
    if not folder or not blocks or k <= 0:
        return asked.limit(0).mapInArrow(lambda b: iter(()), schema).drop("by")
    folder = folder[0].rsplit("/", 1)[0]
    parts = min(len(index.inputFiles()), -(-asked.sparkSession.sparkContext.defaultParallelism // blocks))
    spread = asked.repartition(blocks)
    out = spread.mapInArrow(search(folder, 0, parts), schema)
    for i in range(1, parts):
        out = out.unionByName(spread.mapInArrow(search(folder, i, parts), schema))
    return (top_k(out.drop("rank"), k, key, by="by", partition=name) if parts > 1 else out).drop("by")


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text", k1: float = K1, b: float = B, digits: int = 9) -> DataFrame:
    """``(query_id, key, score, rank)``: the exact k best of ``bm25`` for many queries.

    The index is written once: of at most ``SHARD_ROWS`` chunks each, the postings by term. A task adds up its queries'
    terms over all chunks of a shard as whole numbers, each part rounded up, so that no sum is too small; only chunks
    whose sum may reach the k best so far are scored as ``bm25`` does. Ranks go by scores rounded to ``digits``, so that
    ties do not depend on the order of sums; equal ones go by key.
    """
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(chunks.schema[key].dataType)
    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)[key]

    def postings_of(t: pa.Table) -> pa.RecordBatch:
        n, ts = t.num_rows, t.column(1).combine_chunks()
        lens = ts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        flat = ts.flatten().dictionary_encode()
        cell, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
        starts = np.searchsorted(cell, np.arange(len(flat.dictionary) + 1, dtype=np.int64) * n)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (lens, starts.astype(np.int64), (cell % n).astype(np.uint16), tf.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([t.column(0).to_pylist()], pa.list_(kind)), pa.array([flat.dictionary.to_pylist()], pa.list_(pa.string())), *blobs], names=["keys", "terms", "lens", "starts", "ids", "tfs"])

    sized = chunks.select(key, X.fts_terms(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    index = written(sized.mapInArrow(_gathered(postings_of), f"keys array<{kinds[1]}>, terms array<string>, lens binary, starts binary, ids binary, tfs binary"))
    asked = queries.select("query_id", F.array_distinct(X.fts_terms("query")).alias("ts")).filter(F.size("ts") > 0)

    def block(t: pa.Table, folder: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        ts = t.column(1).combine_chunks()
        size = ts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ts.flatten().dictionary_encode()
        code, begin, words = flat.indices.to_numpy().astype(np.int64), np.r_[0, size.cumsum()], flat.dictionary
        places = lambda s: pc.fill_null(pc.index_in(s["terms"].values, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        read = lambda s, c, kind: np.frombuffer(s[c].as_buffer(), kind)
        n, total, df = 0, 0, np.zeros(len(words) + 1)
        for s in _shards(folder, ["terms", "lens", "starts"]):
            lens = read(s, "lens", np.int32)
            n, total = n + len(lens), total + int(lens.sum(dtype=np.int64))
            df[places(s)] += np.diff(read(s, "starts", np.int64))
        df, avg_len = df[:-1], total / max(n, 1)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        # No part is above idf * (k1 + 1); a sum of parts rounded up fits the whole numbers.
        most = np.add.reduceat(idf[code], begin[:-1]).max() * (k1 + 1)
        whole = np.uint16 if size.max() < 30_000 else np.uint32
        unit = max(most / (np.iinfo(whole).max - size.max() - 1), 1e-7)
        best = _Best(len(size), k, digits)
        for s in _shards(folder, ["keys", "terms", "lens", "starts", "ids", "tfs"], part, parts):
            keys, lens, each, at = np.array(s["keys"].as_py()), read(s, "lens", np.int32), np.diff(read(s, "starts", np.int64)), places(s)
            rows = len(lens)
            used = np.repeat(at >= 0, each)
            local = np.repeat(np.arange(len(at)), each)[used]
            ids, tf = read(s, "ids", np.uint16)[used].astype(np.int64), read(s, "tfs", np.int32)[used]
            parts_of = idf[at[local]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[ids] / avg_len))
            up, cell = np.ceil(parts_of / unit).astype(whole), local * rows + ids
            # Terms in many of these chunks have a row over all, the others their own chunks.
            place, full, thin = np.full(len(words), -1), np.full(len(words), -1), {}
            place[at[at >= 0]] = np.flatnonzero(at >= 0)
            many = np.flatnonzero((at >= 0) & (each * DENSE >= rows))
            full[at[many]] = np.arange(len(many))
            table = np.zeros((len(many), rows), whole)
            row = full[at[local]]
            table[row[row >= 0], ids[row >= 0]] = up[row >= 0]
            span = np.searchsorted(local, np.arange(len(at) + 1))
            for j in np.flatnonzero((at >= 0) & (each * DENSE < rows)):
                thin[int(at[j])] = ids[span[j] : span[j + 1]], up[span[j] : span[j + 1]]
            lows = np.floor((best.least - 1e-8) / unit)
            found, counts, total_of = [], np.zeros(len(size), np.int64), np.empty(rows, whole)
            for i in range(len(size)):
                total_of[:] = 0
                for c, r in zip(code[begin[i] : begin[i + 1]].tolist(), full[code[begin[i] : begin[i + 1]]].tolist(), strict=True):
                    if r >= 0:
                        np.add(total_of, table[r], out=total_of)
                    elif c in thin:
                        total_of[thin[c][0]] += thin[c][1]
                low = lows[i]
                if low == -np.inf and rows > k:
                    low = float(np.partition(total_of, rows - k)[rows - k]) - size[i] - 1
                hit = np.flatnonzero(total_of >= whole(max(low, 1)))
                counts[i] = len(hit)
                found.append(hit)
            q, hit = np.repeat(np.arange(len(size)), counts), np.concatenate(found)
            # Some candidates at a time, each with all terms of its query.
            for lo in range(0, len(q), CANDIDATES):
                a, c = q[lo : lo + CANDIDATES], hit[lo : lo + CANDIDATES]
                own = np.r_[0, size[a].cumsum()]
                term = code[np.repeat(begin[a] - own[:-1], size[a]) + np.arange(own[-1])]
                want = place[term] * rows + np.repeat(c, size[a])
                pos = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
                score = np.add.reduceat(np.where((cell[pos] == want) & (place[term] >= 0), parts_of[pos], 0.0), own[:-1])
                best.add(a, keys[c], score)
            best.settle()
        yield from best.batches(t.column(0).combine_chunks(), kind, ["query_id", key, "score", "by", "rank"])

    return _searched(index, asked, k, key, kinds, _in_blocks(block))


def _in_blocks(block: Callable) -> Callable:
    """``search(folder, part, parts)`` that hands a task's queries on, at most ``QUERY_BLOCK`` at a time."""

    def search(folder: str, part: int, parts: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := [b for b in batches if b.num_rows]:
                t = pa.Table.from_batches(held)
                each = -(-t.num_rows // -(-t.num_rows // QUERY_BLOCK))
                for lo in range(0, t.num_rows, each):
                    yield from block(t.slice(lo, each).combine_chunks(), folder, part, parts)

        return run

    return search


def top_k(scored: DataFrame, k: int, key: str, by: str = "score", partition: str = "query_id") -> DataFrame:
    """The k best of each query, equal scores by key, with ``rank`` from 1. Catalyst prunes each partition to k before the shuffle."""
    w = Window.partitionBy(partition).orderBy(F.desc(by), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", query_key: str = "query_id", query_vec: str = "query_vec", digits: int = 9) -> DataFrame:
    """``(query_id, key, score, rank)``: exact search by cosine of each query against all rows.

    The vectors are written once, in shards of at most ``SHARD_ROWS``. A task multiplies its queries with a shard in
    single precision; what may reach the k best so far, within the error of that, is computed in double. Ranks go by
    scores rounded to ``digits``, equal ones by key. Zero vectors score 0.
    """
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(vectors.schema[key].dataType)
    kinds = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
    held = np.float32 if vectors.schema[vec].dataType.elementType.typeName() == "float" else np.float64

    def shard(t: pa.Table) -> pa.RecordBatch:
        m = np.array(t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False), held)
        return pa.RecordBatch.from_arrays([pa.array([t.column(0).to_pylist()], pa.list_(kind)), pa.array([m.tobytes()], pa.binary())], names=["keys", "data"])

    def unit(m: np.ndarray) -> np.ndarray:
        m = m.astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        return m

    index = written(vectors.select(key, vec).mapInArrow(_gathered(shard), f"keys array<{kinds[1]}>, data binary"))

    def block(t: pa.Table, folder: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        qs = unit(np.array(t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1))
        narrow = qs.astype(np.float32)
        slack = (qs.shape[1] + 8) * 2.0**-23 + 1e-8
        best = _Best(len(qs), k, digits)
        for s in _shards(folder, ["keys", "data"], part, parts):
            keys = np.array(s["keys"].as_py())
            m = unit(np.frombuffer(s["data"].as_buffer(), held).reshape(len(keys), -1))
            across = np.ascontiguousarray(m.astype(np.float32).T)
            for lo in range(0, len(qs), 256):
                x = narrow[lo : lo + 256] @ across
                low = best.least[lo : lo + 256] - slack
                new = np.flatnonzero(low == -np.inf)
                if len(new) and len(keys) > k:
                    low[new] = np.partition(x[new], len(keys) - k, axis=1)[:, len(keys) - k] - 2 * slack
                row, at = np.nonzero(x >= low.astype(np.float32)[:, None])
                for c in range(0, len(row), CANDIDATES):
                    a, o = row[c : c + CANDIDATES] + lo, at[c : c + CANDIDATES]
                    best.add(a, keys[o], np.einsum("ij,ij->i", qs[a], m[o]))
            best.settle()
        yield from best.batches(t.column(0).combine_chunks(), kind, [query_key, key, "score", "by", "rank"])

    return _searched(index, queries.select(query_key, query_vec), k, key, kinds, _in_blocks(block))


def reciprocal_rank_fusion(lists: list[tuple[float, DataFrame]], key: str, k_const: float = RRF_K, partition: str = "query_id") -> DataFrame:
    """``(query_id, key, score)``: sum of weight / (constant + rank); lists of no weight are left out, a key counts once in a list."""
    parts = [d.groupBy(partition, key).agg(F.min("rank").alias("rank")).select(partition, key, (F.lit(float(w)) / (F.lit(float(k_const)) + F.col("rank"))).alias("part")) for w, d in lists if w > 0]
    if not parts:
        d = lists[0][1]
        return d.select(partition, key, F.lit(0.0).alias("score")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(partition, key).agg(F.sum("part").alias("score"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int, alpha: float = 0.5, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Lexical and hashed-vector search fused; ``alpha`` is the vectors' weight. k = 0 gives nothing."""
    depth = max(4 * k, 50)
    lexical = bm25_top_k(chunks, queries, depth, key, text)
    vectors = chunks.select(key, V.hash_embedding(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))
    semantic = vector_search(vectors, queries.select("query_id", V.hash_embedding("query").alias("query_vec")), depth, key, "embedding")
    fused = reciprocal_rank_fusion([(1 - alpha, lexical), (alpha, semantic)], key)
    return top_k(fused, k, key)


def with_snippet(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id", text: str = "text", words: int = SNIPPET) -> DataFrame:
    """Hits with the first words of their chunk."""
    return hits.join(chunks.select(key, X.leading_words(F.coalesce(F.col(text), F.lit("")), words).alias("snippet")), key)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last complete or partial run of each document: by finish, then by key."""
    w = Window.partitionBy("hash").orderBy(F.desc_nulls_last("finished_at"), F.desc("run_key"))
    return runs.filter(F.col("status").isin("complete", "partial")).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def run_fingerprint(run_key: Column, title: Column, texts: Column) -> Column:
    """Digest of what the index holds of a run; parts are length-prefixed, so that no two runs read alike."""
    part = lambda c: F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(part(run_key), part(title), F.array_join(F.transform(texts, part), "")), 256)


def stale_documents(indexed: DataFrame, current: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """Documents whose fingerprint is new or changed; unchanged ones are dropped by an anti join."""
    return current.join(indexed.select(doc, "fingerprint"), [doc, "fingerprint"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def index_stats(chunks: DataFrame, vectors: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """One row: documents, chunks, vectors."""
    return chunks.agg(F.count_distinct(doc).alias("documents"), F.count("*").alias("chunks")).crossJoin(vectors.agg(F.count("*").alias("vectors")))


def check_embedder(index: DataFrame, name: str, dim: int) -> None:
    """An error if an index (embedder, dim) was made by another embedder or with other dimensions; an empty one fits all."""
    other = index.filter((F.col("embedder") != name) | (F.col("dim") != dim)).select("embedder", "dim").limit(1).collect()
    if other:
        raise ValueError(f"the index holds vectors of {other[0].embedder} with {other[0].dim} dimensions, not of {name} with {dim}")


#: Vectors that an index's centres are fitted on, at most; centres, at most; rows of one list in one group, at most.
FITTED, CENTRES, LIST_ROWS = 20_000, 1024, 20_000


def fit_index(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", rounds: int = 8, recall: float = 0.995, seed: int = 3) -> tuple[np.ndarray, int]:
    """Unit centres of a vector index and how many lists a query must look into.

    The centres, about the square root of the rows' number, are found by spherical k-means on a random sample of at
    most about ``FITTED`` rows. Of up to 200 of them, the ten nearest others are known, and the number of lists is the
    one that holds a share ``recall`` of these; vectors without clusters need nearly all lists.
    """
    import numpy as np

    n = vectors.count()
    share = int(min(1.0, FITTED / max(n, 1)) * (1 << 62))
    sample = vectors.filter(F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1)) < share).select(vec).limit(2 * FITTED).collect()
    x = np.array([r[0] for r in sample], np.float64)
    if not len(x):
        return np.zeros((0, 0)), 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(len(x), CENTRES, max(1, round(n**0.5))), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        filled = np.linalg.norm(total, axis=1) > 1e-12
        c[filled] = total[filled] / np.linalg.norm(total[filled], axis=1, keepdims=True)
    asked = rng.choice(len(x), min(200, len(x)), replace=False)
    nearest = np.argsort(-(x[asked] @ x.T), axis=1)[:, :11]
    home = (x @ c.T).argmax(1)
    place = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1), axis=1)
    ranks = np.take_along_axis(place, home[nearest], axis=1)
    return c, int(np.quantile(ranks, recall, method="higher")) + 1


def index_search(vectors: DataFrame, queries: DataFrame, k: int, index: tuple[np.ndarray, int], key: str = "vec_id", vec: str = "embedding", query_key: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """``(query_id, key, score, rank)``: approximate search by inverted lists. Every row is in the list of its nearest centre; a query looks into so many of the nearest lists as ``fit_index`` found, exactly.

    Lists are split into groups of about ``LIST_ROWS``, so that a centre that many rows share is no single task. Zero
    vectors score 0 where they are met.
    """
    import numpy as np

    centres, probe = index
    if not centres.size:
        return vectors.limit(0).select(F.lit(None).cast(dict(queries.dtypes)[query_key]).alias(query_key), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))

    def lists(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                near = np.argsort(-(np.array(b.column(1).to_pylist(), np.float64) @ centres.T), axis=1, kind="stable")[:, :most]
                rows = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["list", "id", "v"])

        return run

    kinds = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
    held = written(vectors.select(key, F.col(vec).cast("array<double>")).mapInArrow(lists(1), f"list int, id {kinds[1]}, v array<double>"))
    # At most one row a centre.
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    placed = held.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("list", "part", "id", "v")
    asked = queries.select(query_key, F.col(query_vec).cast("array<double>")).mapInArrow(lists(probe), f"list int, id {kinds[0]}, v array<double>")
    asked = asked.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")

    def search(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({query_key: a["id"][:0], key: b["id"][:0], "score": pd.Series([], dtype=float)})
        q, m = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        s = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)) @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)).T
        row, at = np.nonzero(s >= np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0), None])
        return pd.DataFrame({query_key: a["id"].to_numpy()[row], key: b["id"].to_numpy()[at], "score": s[row, at]})

    scored = asked.groupBy("list", "part").cogroup(placed.groupBy("list", "part")).applyInPandas(search, f"{query_key} {kinds[0]}, {key} {kinds[1]}, score double")
    return top_k(scored, k, key, partition=query_key)
