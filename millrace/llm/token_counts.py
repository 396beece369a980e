"""Token counts without ids.

A text's pre-tokens are its words with the spaces before them: no piece of the vocabulary goes
across the start of such a run of spaces (checked when the model is loaded), so the pieces of a
text are those of its pre-tokens. Pieces are counted once per distinct pre-token, in a table of
(pre-token, pieces); the documents' frequencies join it and are summed.

The join is heavy-light. The most frequent pre-tokens, at most ``HEAD`` of them and none longer than
``HEAD_BYTES``, are broadcast with their counts, and a document's head frequencies are summed where
they are read. Every other pre-token of a document becomes a row (document, pre-token, frequency) and
joins the rest of the table by a shuffle. A hot word is thus in the head, and nothing that grows is
broadcast. Texts are split by Arrow; only those with runs of spaces go through Python strings.

Defined cases: a null or empty text has no tokens; equal or null ids and equal rows stay apart, each
row has its own result; a very long word is one pre-token; an empty table gives an empty one; only
``doc_id`` and ``text`` are read. Pre-tokens are compared as such, not by hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

MODEL = "piece_bpe_32k.model"
HEAD, HEAD_BYTES = 1 << 17, 64
#: Distinct pre-tokens a task counts before it hands them on.
HELD = 400_000
MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_models: dict = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(m.get_piece_size()):
            if not m.is_control(i) and MARK in m.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece goes across words; this vocabulary can't be counted word by word")
        _models[path] = m
    return _models[path]


def pretokens(text: str) -> list[str]:
    """The words of a text with the spaces before them, less the space that the model itself puts before a text."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")  # the model writes a space so: the two are one to it
    words = text.split(" ")
    if "" not in words:
        return words
    return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]


def _words(column) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Row ranges with all their pre-tokens, and the row of the range that each is of."""
    _, offsets = C.bytes_of(column)
    for i, j in C.steps(offsets):
        texts = column.slice(i, j - i)
        some = np.diff(offsets[i : j + 1]) > 0
        odd = some & pc.fill_null(pc.match_substring_regex(texts, f"^ |  | $|{MARK}"), False).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(some & ~odd)
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        rows = [np.repeat(plain, pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        words = [split.flatten()]
        for k in np.flatnonzero(odd).tolist():
            own = pretokens(texts[k].as_py())
            words.append(pa.array(own, words[0].type))
            rows.append(np.full(len(own), k))
        yield i, j, pa.concat_arrays(words), np.concatenate(rows).astype(np.int64)


def vocabulary_counts(rows: DataFrame, path: str) -> DataFrame:
    """(piece, pieces, n) per distinct pre-token of all texts: how many pieces it has and how often it occurs."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, _, words, _ in _words(batch.column("text")):
                times = words.value_counts()
                for word, n in zip(times.field("values").to_pylist(), times.field("counts").to_pylist()):
                    seen[word] += n
                if len(seen) >= HELD:
                    yield flush()
        if seen:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            sizes = [len(x) for x in m.encode(pieces, num_threads=1)] if pieces else []
            # an empty pre-token is the space that the model puts before a text, where it stands alone
            sizes = [n if p else 1 for n, p in zip(sizes, pieces)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(sizes, pa.int32()), batch.column("n")], ["piece", "pieces", "n"])

    seen = C.map_arrow(rows.select("text"), local, "piece string, n long")
    return C.map_arrow(seen.groupBy("piece").agg(F.sum("n").alias("n")), count, "piece string, pieces int, n long")


def token_counts(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one for each row of ``docs``."""
    path = path or model_path()
    spark = docs.sparkSession
    # a row keeps its own identity through the join, whatever its id is
    rows = C.id_and_text(docs)
    vocabulary = C.materialise(vocabulary_counts(rows, path), "pieces")
    top = C.most_frequent(vocabulary.where(F.octet_length("piece") <= HEAD_BYTES), "n", head).select("piece", "pieces").toArrow().combine_chunks()
    known = spark.sparkContext.broadcast((pa.array(top.column("piece").to_pylist(), pa.string()), top.column("pieces").to_numpy()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, head_pieces = known.value
        for batch in batches:
            column = batch.column("text")
            size = np.diff(C.bytes_of(column)[1])
            for i, j, words, row in _words(column):
                at = pc.index_in(words, value_set=head_words)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                at = at.fill_null(0).to_numpy()
                sums = np.bincount(row[hit], head_pieces[at[hit]], j - i).astype(np.int64)
                rest = words.filter(pa.array(~hit)).dictionary_encode()
                # one number for each row and word, rows first
                kinds = max(1, len(rest.dictionary))
                each, freq = np.unique(row[~hit] * kinds + rest.indices.to_numpy(), return_counts=True)
                off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(each // kinds, minlength=j - i))]), pa.int32())
                tail = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([rest.dictionary.take(pa.array(each % kinds)), pa.array(freq, pa.int32())], ["piece", "freq"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(size[i:j]), pa.array(sums), tail], ["doc_id", "n_bytes", "head_tokens", "tail"])

    parts = C.map_arrow(rows, split, "doc_id long, n_bytes long, head_tokens long, tail array<struct<piece:string,freq:int>>")
    parts = C.materialise(parts.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    tail = parts.select("row", F.inline("tail")).join(vocabulary.select("piece", "pieces"), "piece")
    tail = tail.groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("tail_tokens"))
    out = parts.drop("tail").join(tail, "row", "left")
    return out.select("doc_id", "n_bytes", (F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))).alias("n_tokens"))
