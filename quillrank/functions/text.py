"""The tokenizer: one Column expression for documents and queries alike."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import TokenizationError
from .stemming import STEMMERS
from .stopwords import CODES, for_language

WORDS = r"\w+"


@dataclass(frozen=True)
class Tokenizer:
    """Matches of a pattern in the text as it is, each in small letters, stemmed, and left out if a stop word, in this order.

    Stop words are compared with the stems, as they are spelled; ``stop_before_stem`` compares them with the words. ``custom`` (text to
    tokens) takes the place of all of it and gets the text as it is. Word characters are Unicode's.
    """

    pattern: str = WORDS
    lowercase: bool = True
    stopwords: tuple[str, ...] = ()
    stemmer: str | None = None
    stop_before_stem: bool = False
    custom: Callable[[str], list[str]] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "stopwords", tuple(self.stopwords))
        if self.stemmer is not None and self.stemmer not in STEMMERS:
            raise TokenizationError(f"no stemmer {self.stemmer!r}; there are {', '.join(sorted(STEMMERS))}")
        spark = SparkSession.getActiveSession()
        try:
            # executors use Java's expressions, of which Python's are nearly a part
            if spark is not None:
                spark._jvm.java.util.regex.Pattern.compile("(?U)" + self.pattern)
            else:
                re.compile(self.pattern)
        except Exception as e:
            raise TokenizationError(f"bad token pattern {self.pattern!r}: {str(e).splitlines()[0]}") from None

    def language(self, name: str) -> Tokenizer:
        """With the stop words and the stemmer of a language, by its English name or ISO code; what there is none of stays unchanged."""
        words = for_language(name)
        known = CODES.get(name.strip().lower(), name.strip().lower())
        return replace(self, stopwords=self.stopwords if words is None else tuple(words), stemmer=known if known in STEMMERS else self.stemmer)

    def tokens(self, text: Column) -> Column:
        """Array of the tokens of ``text``; empty for a null text."""
        text = F.coalesce(text, F.lit(""))
        if self.custom is not None:
            return _custom(self.custom)(text)
        # small letters are word characters as their capitals are, so for words the text as a whole can be lowered, which is cheaper
        whole = self.lowercase and self.pattern == WORDS
        found = F.regexp_extract_all(F.lower(text) if whole else text, F.lit("(?U)" + self.pattern), F.lit(0))
        if self.lowercase and not whole:
            found = F.transform(found, F.lower)
        steps = [self._stemmed, self._stopped]
        for step in reversed(steps) if self.stop_before_stem else steps:
            found = step(found)
        return found

    def _stemmed(self, tokens: Column) -> Column:
        return tokens if self.stemmer is None else _stems(self.stemmer)(tokens)

    def _stopped(self, tokens: Column) -> Column:
        return F.filter(tokens, lambda t: ~t.isin(*self.stopwords)) if self.stopwords else tokens

    def to_json(self) -> str:
        """For storing; a custom function can't be stored."""
        if self.custom is not None:
            raise TokenizationError("a tokenizer with a function of its own can't be stored")
        return json.dumps({k: v for k, v in asdict(self).items() if k != "custom"})

    @staticmethod
    def from_json(text: str) -> Tokenizer:
        return Tokenizer(**json.loads(text))


def _custom(function: Callable[[str], list[str]]):
    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(function)

    return run


def _stems(name: str):
    """Stems of arrays of words, by way of the distinct words of a batch."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stem = STEMMERS[name]
        known: dict[str, str] = {}
        for words in batches:
            flat = words.flatten().dictionary_encode()
            for w in flat.dictionary.to_pylist():
                if w not in known:
                    known[w] = stem(w)
            stems = pa.array([known[w] for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
            offsets = words.offsets.to_numpy()
            yield pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), stems)
            if len(known) > 1_000_000:
                known.clear()

    return run
