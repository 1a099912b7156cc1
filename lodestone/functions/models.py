"""Chunking and model calls: the pieces that have no column expression, as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import REFERENCE_CHARS


def chunk_spans(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans of overlapping chunks: at most `size`, ended after the last blank line or else sentence end in their second half."""
    spans, start, n = [], 0, len(text)
    while start < n:
        end = start + size
        if end < n:
            half = start + size // 2
            cut = text.rfind("\n\n", start, end)
            if cut <= half:
                cut = max(text.rfind(mark, start, end) for mark in (". ", "! ", "? "))
            if cut > half:
                end = cut + 2
        spans.append((start, min(end, n)))
        start = max(end - overlap, start + 1) if end < n else n  # always forward
    return spans


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 200, key: str = "doc_id") -> DataFrame:
    """key, chunk_no, start, text: the chunks of each text, stripped; blank ones are left out."""

    @F.pandas_udf("array<struct<start:int,text:string>>")
    def cut(texts):
        def one(t):
            parts = [(a, t[a:b].strip()) for a, b in chunk_spans(t or "", size, overlap)]
            return [{"start": a, "text": p} for a, p in parts if p]

        return texts.map(one)

    return docs.select(key, F.posexplode(cut("text")).alias("chunk_no", "c")).select(key, "chunk_no", F.col("c.start").alias("start"), F.col("c.text").alias("text"))


def hashed_embedding(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder that stands in for a model: signed hashes of words, scaled to length 1."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % dims] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, text: str = "text", model: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_embedding, batch: int = 64) -> DataFrame:
    """df with `embedding`. `model` is made once a task and called with lists of at most `batch` texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = model()
        for texts in batches:
            rows = [call([t or "" for t in texts[i : i + batch]]).astype(np.float32) for i in range(0, len(texts), batch)]
            yield pd.Series([r for block in rows for r in block], index=texts.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    run = F.pandas_udf(run, T.ArrayType(T.FloatType()))
    return df.withColumn("embedding", run(text))


def with_retry(call: Callable, tries: int = 4, first_wait: float = 1.0, most_wait: float = 8.0, jitter: float = 0.2, retry_on: Callable[[Exception], bool] = lambda _: True) -> Callable:
    """The call, repeated after growing waits while retry_on accepts its error; the last error is raised."""
    import random
    import time

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception as error:
                if n + 1 == tries or not retry_on(error):
                    raise
                time.sleep(min(most_wait, first_wait * 2**n) * (1 + random.uniform(-jitter, jitter)))

    return run


#: Texts that a hosted service takes in one request, and that it is sent in one call at all.
PER_REQUEST, PER_CALL = 8, 32


def embed_by_service(docs: DataFrame, service: Callable[[], Callable[[list[str]], list]], text: str = "text", per_request: int = PER_REQUEST, call: int = PER_CALL,
                     wait: float = 1.0) -> DataFrame:
    """docs with `embedding` from a hosted service, made once a task.

    Texts of an Arrow batch are sent in calls of at most `call` texts (more than PER_CALL are refused) and requests of at
    most `per_request`. Lost connections are tried again after growing waits. An answer without one vector of numbers
    for each text is asked for text by text; if that fails too, the job does. A missing column is an error at once, a
    null text is embedded as an empty one.
    """
    if text not in docs.columns:
        raise ValueError(f"documents have no field {text}")
    if call > PER_CALL:
        raise ValueError(f"a hosted service takes {PER_CALL} texts a call at most, not {call}")

    def checked(answer, n: int) -> list:
        if len(answer) != n or any(not isinstance(v, (list, np.ndarray)) or not len(v) or np.ndim(v) != 1 for v in answer):
            raise ValueError(f"no {n} vectors")
        return [np.asarray(v, np.float32) for v in answer]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        send = with_retry(service(), first_wait=wait, retry_on=lambda e: isinstance(e, (ConnectionError, TimeoutError)))

        def request(texts: list[str]) -> list:
            try:
                return checked(send(texts), len(texts))
            except ValueError:
                if len(texts) == 1:
                    raise
                return [checked(send([t]), 1)[0] for t in texts]

        for texts in batches:
            known, out = [t or "" for t in texts], []
            for i in range(0, len(known), call):
                group = known[i : i + call]
                for j in range(0, len(group), per_request):
                    out += request(group[j : j + per_request])
            yield pd.Series(out, index=texts.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("embedding", F.pandas_udf(run, T.ArrayType(T.FloatType()))(text))


def complete(prompts: DataFrame, chat: Callable[[], Callable[[str], str]], key: str = "query_id") -> DataFrame:
    """key, answer of each prompt; `chat` is made once a task."""
    schema = T.StructType([prompts.schema[key], T.StructField("answer", T.StringType())])

    def run(batches):
        call = chat()
        for b in batches:
            yield b[[key]].assign(answer=[call(p or "") for p in b["prompt"]])

    return prompts.select(key, "prompt").mapInPandas(run, schema)


def evaluate_references(hits: DataFrame, chat: Callable[[], Callable[[str], str]], most: int = 20, threshold: float = 0.3) -> DataFrame:
    """query_id, chunk_id, relevance, description: a model's judgement of the first hits, or the best three by score.

    The answer is JSON, an array or an object with `references`; unknown ids, blank descriptions and low relevances go,
    the best relevance of an id counts.
    """
    from pyspark.sql import Window

    from .text import collapse, fenced_json, truncate

    top = hits.where(F.col("rank") <= most)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", truncate(F.col("text"), REFERENCE_CHARS).alias("t")))),
                                     lambda x: F.concat(x["chunk_id"], F.lit(": "), x["t"])), "\n")
    answers = complete(top.groupBy("query_id").agg(lines.alias("prompt")), chat)
    item = "array<struct<chunk_id:string,description:string,relevance:double>>"
    j = fenced_json(F.col("answer"))
    rows = answers.select("query_id", F.explode(F.coalesce(F.from_json(F.when(j.startswith("["), j), item), F.from_json(F.when(j.startswith("{"), j), f"struct<references:{item}>")["references"])).alias("r"))
    rel = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("r.relevance", F.lit(0.0)))), 4)
    judged = rows.select("query_id", F.col("r.chunk_id").alias("chunk_id"), rel.alias("relevance"), collapse(F.col("r.description")).alias("description")).where(
        (F.col("description") != "") & (F.col("relevance") >= threshold)).join(top.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    best = judged.groupBy("query_id", "chunk_id").agg(F.max_by(F.struct("relevance", "description"), "relevance").alias("x")).select("query_id", "chunk_id", "x.*")
    scale = F.max("score").over(Window.partitionBy("query_id"))
    fallback = top.withColumn("relevance", F.bround(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce(F.try_divide("score", scale), F.lit(0.05)))), 4)).withColumn(
        "n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).where("n <= 3")
    missing = fallback.join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "relevance", F.lit("ranked high").alias("description"))
    return best.unionByName(missing)
