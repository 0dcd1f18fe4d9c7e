"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where both sides provably agree.

A text up to ``CHUNK`` characters is encoded at once. A longer one is encoded in chunks that overlap, with the offsets
of the tokens and the pre-tokens ("words") that they belong to. Two neighbours are spliced at a place that

- is the start of a word in both encodings,
- lies at least ``margin`` characters behind the start of the right chunk and before the end of the left one.

Why that is right: a byte-level pre-tokenizer reads from left to right, looks one character ahead and never back, and
merges stay inside a word. So from a common word start on, the right chunk's words are those of the whole text, and
up to it the left chunk's are, once no special string can reach over the place: ``margin`` exceeds the longest. If an
overlap has no such place, as in a run of letters without end, it is widened to twice its length until one is found
or the chunk holds the rest of the text.

Files ending in .json are read by tokenizers, .model by sentencepiece, .tiktoken by tiktoken. For a .json with plain
byte-level BPE, short texts are counted by tiktoken's faster merge loop over the vocabulary of that same file, which
gives the same tokens (tests compare the two). Tokenizers without such a pre-tokenizer encode each text at once.

Defined results: null counts as the empty text, with 0 bytes and 0 tokens; rows are independent of each other, so
repeated rows repeat results, and ties cannot occur; a very long text is counted whole, in overlapping chunks. An empty
table gives an empty result. Other columns stay where ``keep`` is set, apart from those of the result's names.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Fixed value: the pattern that splits text into words before byte-level BPE.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_byte_level(spec: dict) -> bool:
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    return (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )


def counter(name: str, data: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[str], int]:
    """Counts the tokens of a text as the library for the file named ``name`` does."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda text: len(model.encode(text))
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    from tokenizers import Tokenizer

    spec = json.loads(data)
    whole = Tokenizer.from_str(data.decode())
    whole.no_truncation()
    whole.no_padding()
    if not is_byte_level(spec):
        return lambda text: len(whole.encode(text, add_special_tokens=False))
    import tiktoken

    letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("same", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    margin = 1 + max(map(len, special), default=0)

    def encode(text: str):
        got = whole.encode(text, add_special_tokens=False)
        starts, words = np.array([a for a, _ in got.offsets], dtype=np.int64), np.array([-1 if w is None else w for w in got.word_ids], dtype=np.int64)
        return starts, starts[np.concatenate(([True], words[1:] != words[:-1]))] if len(starts) else starts

    return lambda text: len(fast.encode(text, allowed_special="all")) if len(text) <= chunk else spliced(text, encode, chunk, overlap, margin)


def spliced(text: str, encode, chunk: int, overlap: int, margin: int) -> int:
    """The number of tokens. ``encode`` gives for a text the start of each token and the starts of the words."""
    total, at, end = 0, 0, min(len(text), chunk)
    tokens, words = encode(text[:end])
    begin = 0  # where the left chunk begins; it counts from ``at`` on
    while end < len(text):
        width = overlap
        while True:
            left = max(at, end - width)
            right_end = min(len(text), left + max(chunk, 2 * width))
            more_tokens, more_words = encode(text[left:right_end])
            common = np.intersect1d(words + begin, more_words + left)
            common = common[(common >= left + margin * (left > 0)) & (common <= end - margin) & (common > at)]
            if len(common):
                break
            if left == at:  # the left chunk's whole part is inside: a chunk that reaches further takes its place
                tokens, words, begin, end = more_tokens, more_words, left, right_end
                if end == len(text):
                    return total + len(tokens)
                chunk *= 2
            width *= 2
        place = int(common[-1])
        total += int(((tokens + begin >= at) & (tokens + begin < place)).sum())
        at, begin, end, tokens, words = place, left, right_end, more_tokens, more_words
    return total + int((tokens + begin >= at).sum())


def count(documents: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each document. The file at ``path`` (a few MB) goes to the tasks from the driver."""
    name = os.path.basename(path)
    with open(path, "rb") as f:
        shipped = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens_of = counter(name, shipped.value, chunk, overlap)
        for texts in batches:
            yield pd.Series([tokens_of(t) if t else 0 for t in texts], dtype="int64")

    rest = [c for c in documents.columns if c not in ("n_bytes", "n_tokens", "over_limit")] if keep else ["doc_id"]
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return documents.select(*rest, n_bytes.alias("n_bytes"), F.pandas_udf(run, "long")(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
