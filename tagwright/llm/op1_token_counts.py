"""Token counts of whole texts by a public tokenizer file, with overlap resynchronisation for huge documents.

Texts up to ``chunk_chars`` are counted whole: they are cut before white space that follows other characters, where the
tokenizer's own pattern always starts a new piece, and each distinct unit is encoded once per worker while it is remembered.
A longer text is encoded as overlapping chunks with offsets. Two neighbouring chunks are spliced at a position where both start
a piece, proven stable: the pattern scans forward only, so from a common start on both give the same tokens, provided the
position lies after the later chunk's first piece and a margin before the earlier chunk's end. Where an overlap holds no such
position, it is doubled, up to the rest of the text.

Null texts count as empty (0 tokens); null ids and repeated rows are kept as they are; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices

CHUNK_CHARS, OVERLAP_CHARS, TOKEN_LIMIT = 32_768, 512, 1024
#: Characters before a chunk's end in which nothing is trusted: longer than any special token and any look-ahead.
MARGIN_CHARS = 64
#: Units remembered by a worker; when full it starts anew.
REMEMBERED = 600_000
#: Unicode White_Space is what the tokenizers' \s matches; Python's has U+001C to U+001F besides.
UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def piece_starts(encoding, base: int) -> tuple[list[int], list[int]]:
    """Absolute start offsets of the pieces of one chunk, and the number of tokens before each."""
    starts, before, last = [], [], object()
    for i, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last or word is None:
            starts.append(base + a)
            before.append(i)
            last = word
    return starts, before


def count_overlapping(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a long text from overlapping chunks; equals len(tokenizer.encode(text)) without added specials."""
    def encode(a: int, b: int):
        e = tokenizer.encode(text[a:b], add_special_tokens=False)
        return *piece_starts(e, a), len(e.ids)

    total, start, end = 0, 0, min(len(text), chunk)
    starts, before, n = encode(start, end)
    skip = 0  # tokens of the current chunk that an earlier one has counted
    while end < len(text):
        width = overlap
        while True:
            nxt = max(start, end - width)
            if nxt == start:  # the overlap covers the whole chunk: take a longer chunk instead
                end = min(len(text), end + max(chunk, end - start))
                starts, before, n = encode(start, end)
                if end == len(text):
                    return total + n - skip
                width = overlap
                continue
            nxt_end = min(len(text), nxt + max(chunk, 2 * width))
            s2, b2, n2 = encode(nxt, nxt_end)
            later = dict(zip(s2[1:], b2[1:], strict=True))
            at = next(((a, k) for a, k in zip(starts, before, strict=True) if a in later and a <= end - MARGIN_CHARS and k >= skip), None)
            if at is not None:
                break
            width *= 2
        total += at[1] - skip
        skip, start, end, starts, before, n = later[at[0]], nxt, nxt_end, s2, b2, n2
    return total + n - skip


class Counter:
    """Counts tokens of texts; one per worker and tokenizer file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in self.library.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.whole = lambda texts: [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        # Only for byte-level pieces is the cut before white space proven; others are encoded whole.
        self.by_units = path.endswith(".json") and "ByteLevel" in str(self.library.pre_tokenizer) and self.library.normalizer is None
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def counts(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        if not self.by_units:
            return self.whole(texts)
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = [UNIT.findall(t) if len(t) <= chunk else () for t in texts]
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self.whole(new), strict=True))
        get = self.known.__getitem__
        return [count_overlapping(self.library, t, chunk, overlap) if len(t) > chunk else sum(map(get, u)) for t, u in zip(texts, cut, strict=True)]


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = Counter(tokenizer_path)
        counter = _COUNTERS[tokenizer_path]
        for whole in batches:
            for batch in slices(whole):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n = counter.counts(texts, chunk_chars, overlap_chars)
                size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
