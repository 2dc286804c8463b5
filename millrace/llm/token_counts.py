"""Token counts by a two-tier lookup of pre-token lengths inside the map tasks.

A pre-token (a piece that the tokenizer splits off before it merges pairs) always has
the same number of tokens.  Tier one is a broadcast hash table with the lengths of the
pre-tokens that were frequent enough where the vocabulary was made to become entries of
it; its size is bounded by the vocabulary.  Tier two is a cache in each Python worker
for pre-tokens that tier one misses; a miss there is encoded once.  No pre-token is ever
shuffled, and the texts are read once.

The tokenizer file is read on the driver and broadcast as text, so executors need no
copy of it.  Counts are those of ``Tokenizer.encode`` with ``add_special_tokens=False``:
special strings inside a text count as one token, as is the library's default.

Texts made of printable ASCII and Latin letters up to U+024F, where normal form and
character classes are beyond doubt, are lower-cased and split by the tokenizer's pattern; other texts are
normalised and split by its own steps.  Either way each pre-token is looked up.  Only a text with
a special string, which cuts it in other places, is encoded by the library.

Cases: null and empty texts have no tokens; very long texts and very long pre-tokens are
counted whole (the latter are not cached); equal rows get equal counts; an empty table
gives no rows; other columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64

_WORKER: dict[str, object] = {}  # tokenizers and caches of this Python worker


def pre_token_pattern(config: dict) -> str:
    """The pattern of the tokenizer's ``Split`` step."""
    for step in config["pre_tokenizer"]["pretokenizers"]:
        if step["type"] == "Split" and step["invert"] and step["behavior"] == "Removed":
            return step["pattern"]["Regex"]
    raise ValueError("the tokenizer does not split texts by a pattern of pre-tokens")


# The visible stand-ins of byte-level tokenizers: printable bytes are themselves, the others
# follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_INS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SELF))}


def byte_level(piece: str) -> str:
    return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_STAND_INS)


def _plain(entry: str) -> str:
    """The text of a byte-level entry; empty if it holds bytes that stand for themselves nowhere."""
    try:
        return entry.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return ""


def frequent_lengths(tokenizer_json: str) -> dict[str, int]:
    """Token counts of all vocabulary entries that are whole pre-tokens."""
    import regex
    from tokenizers import Tokenizer

    config = json.loads(tokenizer_json)
    tokenizer = Tokenizer.from_str(tokenizer_json)
    end = config["model"]["end_of_word_suffix"]
    pattern = regex.compile(pre_token_pattern(config))
    special = {t["content"] for t in config["added_tokens"]}
    words = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        word = _plain(entry.removesuffix(end)) if entry.endswith(end) else ""
        if word and word not in special and pattern.findall(word) == [word] and word == word.lower():
            words.append(word)
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return {word: len(e.ids) for word, e in zip(words, encoded, strict=True)}


class Lengths(dict):
    """Both tiers in one hash table of the worker.

    What tier one (the broadcast) lacks is encoded by the library and kept beside it; when
    ``CACHE_ENTRIES`` are kept, the table goes back to tier one.
    """

    def __init__(self, frequent: dict[str, int], tokenizer):
        super().__init__(frequent)
        self._frequent, self._tokenizer = frequent, tokenizer

    def __missing__(self, piece: str) -> int:
        # A piece of the plain alphabet is one pre-token already, so the merges alone decide.
        found = len(self._tokenizer.model.tokenize(byte_level(piece)))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= len(self._frequent) + CACHE_ENTRIES:
                self.clear()
                self.update(self._frequent)
            self[piece] = found
        return found


class Counter:
    """Counts the tokens of texts in one Python worker."""

    def __init__(self, tokenizer_json: str, frequent: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        config = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.lengths = Lengths(frequent, self.tokenizer)
        self.split = regex.compile(pre_token_pattern(config)).findall
        self.special = [t["content"] for t in config["added_tokens"]]
        self.plain = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ]*").fullmatch

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.plain(text):
            return sum(map(self.lengths.__getitem__, self.split(text.lower())))
        clean = self.tokenizer.normalizer.normalize_str(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)
        return sum(self.lengths[clean[begin:end]] for _, (begin, end) in pieces)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048
) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to ``docs``."""
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    # Both are bounded by the tokenizer file.
    shared = spark.sparkContext.broadcast((tokenizer_json, frequent_lengths(tokenizer_json)))

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _WORKER.get(tokenizer_path)
        if counter is None:
            counter = _WORKER[tokenizer_path] = Counter(*shared.value)
        for texts in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"),
            "n_tokens": tokens(F.col(text)),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
