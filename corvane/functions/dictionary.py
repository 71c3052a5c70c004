"""Words by a dictionary: the most probable path through the lattice of a run's dictionary words.

A run (of Han characters, unless another pattern is given) is cut so that the product of its words' shares of the dictionary's counts
is greatest; a character that begins no word stands by itself with the least share. Of equal paths the one whose words are longer from
the left on is taken. Everything else is lower-cased runs of letters and digits, as in the default tokenizer. Whole texts are read; a run costs
its length times the longest word's. A null text has no words.

The dictionary is a parameter, bounded by `most` words, and travels with the function."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import HAN

#: Words of a dictionary.
MOST = 200_000


def dictionary(counted: DataFrame, word: str = "word", n: str = "n", most: int = MOST) -> dict[str, int]:
    """The most frequent words of a table (word, n)."""
    rows = counted.filter(F.col(word).isNotNull() & (F.col(word) != "") & (F.col(n) > 0)).orderBy(F.desc(n), word).limit(most)
    return {r[0]: r[1] for r in rows.select(word, n).collect()}  # most rows


def best_path(run: str, costs: Mapping[str, float], longest: int, unknown: float) -> list[str]:
    """The words of least summed cost, from the end of the run to its start."""
    ways: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
    for at in range(len(run) - 1, -1, -1):
        least = None
        for size in range(1, min(longest, len(run) - at) + 1):
            cost = costs.get(run[at : at + size], unknown if size == 1 else None)
            if cost is not None and (least is None or round(cost + ways[at + size][0], 9) <= round(least[0], 9)):
                least = (cost + ways[at + size][0], size)
        ways[at] = least
    words, at = [], 0
    while at < len(run):
        words.append(run[at : at + ways[at][1]])
        at += ways[at][1]
    return words


def tokenizer(counts: Mapping[str, int], runs: str = f"{HAN}+"):
    """A Column function as words(), to be given to postings and other operators; runs: the pattern of what the dictionary cuts."""
    total = sum(counts.values())
    costs = {w: math.log(total) - math.log(c) for w, c in counts.items()}
    longest, unknown = max(map(len, costs), default=1), math.log(total) if total else 0.0
    pieces = rf"(?P<run>{runs})|[\p{{L}}\p{{N}}--{HAN}]+"

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        pattern = regex.compile(pieces, regex.V1)

        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            out: list[str] = []
            for m in pattern.finditer(text):
                out += best_path(m[0], costs, longest, unknown) if m["run"] else [m[0].lower()]
            return out

        return texts.map(one, na_action=None)

    return cut


def coverage(counts: Mapping[str, int]):
    """A Column function of tokens: the share that the dictionary has, or that is of one character; 0 without tokens. For is_garbled()."""
    known = frozenset(counts)

    @F.pandas_udf("double")
    def share(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ws: sum(len(w) == 1 or w in known for w in ws) / len(ws) if ws is not None and len(ws) else 0.0, na_action=None).astype(float)

    return share
