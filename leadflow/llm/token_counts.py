"""Token counts: the exact count at every prefix of a text, by dynamic programming over its prefixes.

A piece model's encoding of a prefix ends in one token, and what stands before that token is encoded
as the shorter prefix is. So the count of a prefix is the count of a shorter one plus one, and the
token is the one that may stand behind the last token there: the pair must encode as itself.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import values

SPACE = "▁"  # how the model writes a space
PARTS = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")
CACHED = 48  # characters of the parts of a text whose counts are kept
KEPT = 300_000  # parts, and pairs of tokens, that a task keeps at most, beside those of the texts at hand
TOGETHER = 4 << 20  # characters of texts whose parts are learnt together


class PieceModel:
    """The merges of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        inner = next((p for p in self.rank if SPACE in p.lstrip(SPACE)), None)
        if inner is not None or model.encode(" a", out_type=str)[0] not in (SPACE, SPACE * 2, f"{SPACE}{SPACE}a"):
            raise ValueError(f"{path}: texts can't be parted at spaces under this model")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}  # what a token is merged of in the end
        self.back: dict = {}  # all tokens from their last character on
        for piece in self.rank:
            whole, halves = self.merged(piece)
            if whole == [piece]:
                node = self.back
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = piece
                if halves:
                    self.halves[piece] = halves
        self.age = {p: self.rank[p] if p in self.halves else -np.inf for p in self.rank}
        self.plain = {t for t, halves in self.halves.items() if max(map(self.age.__getitem__, halves)) < self.age[t]}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The tokens of a short text, and the last merge: the best pair of neighbours is merged, the leftmost of equals,
        until none is left."""
        out, rank, last = list(text), self.rank, None
        while len(out) > 1:
            best, at = min((rank.get(out[i] + out[i + 1], np.inf), i) for i in range(len(out) - 1))
            if best == np.inf:
                break
            last = out[at], out[at + 1]
            out[at : at + 2] = ["".join(last)]
        return out, last

    def edge(self, token: str, side: int) -> list[tuple[str, float]] | None:
        """The symbols that stand at one side of a token as it grows, each with the rank of the merge that takes it;
        None if its merges don't come in the order of their ranks."""
        out, until = [], np.inf
        while True:
            out.append((token, until))
            halves = self.halves.get(token)
            if not halves:
                return out[::-1]
            if token not in self.plain:
                return None
            token, until = halves[side], self.rank[token]

    def stays(self, before: str, token: str) -> bool:
        """Whether two tokens stay as they are side by side: no merge across their border comes before one inside them."""
        left, right = self.edge(before, 1), self.edge(token, 0)
        if left is None or right is None:
            return self.merged(before + token)[0] == [before, token]
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = left[i], right[j]
            across = self.rank.get(a + b, np.inf)
            if across < until_a and across <= until_b and across < np.inf:  # of equal merges the leftmost is first
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def follows(self, before: str, token: str) -> bool:
        """``stays``, remembered."""
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[before, token] = self.stays(before, token)
        return known

    def extend(self, part: str, last: list[str], steps: list[int], counts: list[int]) -> None:
        """Go on with the prefixes of a part from where the lists end: for each the last token, by how much the
        count changes, and the count. A token is one; a character that the model lacks is one for each of its bytes."""
        pairs, back, follows = self.pairs, self.back, self.follows
        for stop in range(len(counts), len(part) + 1):
            node, start, found = back, stop, []
            while start:
                node = node.get(part[start - 1])
                if node is None:
                    break
                start -= 1
                if "" in node:
                    found.append((start, node[""]))
            for start, token in reversed(found):
                if not start or (pairs.get(pair := (last[start], token)) or pair not in pairs and follows(*pair)):
                    n = counts[start] + 1
                    break
            else:
                token = part[stop - 1]
                if token in self.rank:
                    raise ValueError(f"no token ends the prefix {part[:stop]!r}")
                n = counts[-1] + len(token.encode())
            last.append(token)
            steps.append(n - counts[-1])
            counts.append(n)


class Steps(dict):
    """By part of a text: how the count changes with each of its characters, a signed byte each."""

    code = "b"

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        """Of a part that isn't kept: too long, or none that ``learn`` has seen."""
        steps: list[int] = []
        self.model.extend(part.replace(" ", SPACE), [""], steps, [0])
        return array(self.code, steps).tobytes()

    def learn(self, texts: list[str]) -> None:
        """Keep the steps of all parts of some texts. They are gone through in order, so that each starts behind
        the prefix that it shares with the one before."""
        parts = set()
        for text in texts:
            parts.update(PARTS.findall(text))
        new = [p for p in parts if p not in self and len(p) <= CACHED]
        if len(self) + len(new) > KEPT:
            self.clear()
            new = [p for p in parts if len(p) <= CACHED]
        before, last, steps, counts = "", [""], [], [0]
        for part in sorted(new):
            own, same = part.replace(" ", SPACE), 0
            for a, b in zip(own, before):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], steps[same:], counts[same + 1 :]
            self.model.extend(own, last, steps, counts)
            self[part] = array(self.code, steps).tobytes()
            before = own


class WideSteps(Steps):
    """The same in eight bytes, for texts with a step that a signed byte doesn't hold."""

    code = "q"


@lru_cache(2)
def steps_of(path: str) -> tuple[Steps, WideSteps]:
    model = PieceModel(path)
    return Steps(model), WideSteps(model)


def prefix_stores(texts: list[str | None], path: str) -> list[bytes]:
    """The count at every prefix of each text: the width of a step in bytes, then the step of each character."""
    spaced = [" " + t if t else "" for t in texts]  # the model puts a space before a text
    try:
        return _stores(spaced, steps_of(path)[0])
    except OverflowError:
        wide = steps_of(path)[1]
        return [x for t in spaced for x in _stores([t], wide)] if len(texts) == 1 else [
            x for t in texts for x in prefix_stores([t], path)
        ]


def _stores(texts: list[str], steps: Steps) -> list[bytes]:
    steps.learn(texts)
    width, out = array(steps.code).itemsize, []
    for text in texts:
        own = b"".join(map(steps.__getitem__, PARTS.findall(text)))
        if own:  # no prefix of the text ends behind the first space alone
            first = array(steps.code, own[: 2 * width])
            own = array(steps.code, [first[0] + first[1]]).tobytes() + own[2 * width :]
        out.append(bytes([width]) + own)
    return out


def prefix_store(text: str | None, path: str) -> bytes:
    """``prefix_stores`` of one text."""
    return prefix_stores([text], path)[0]


def prefix_counts(store: bytes) -> np.ndarray:
    """The count of each prefix, by its number of characters."""
    steps = np.frombuffer(store, f"<i{store[0]}", offset=1)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def prefixes(path: str, text: str | Column = "text") -> Column:
    """The store of each text, as ``prefix_store`` makes it."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held, size = [], [], 0
            for t in values(batch):
                held.append(t)
                size += len(t or "")
                if size >= TOGETHER:
                    out += prefix_stores(held, path)
                    held, size = [], 0
            yield pa.array(out + prefix_stores(held, path), pa.binary())

    return of.asNondeterministic()(text)


def tokens_in(store: str | Column) -> Column:
    """The number of tokens of the whole text."""

    @F.arrow_udf("long")
    def of(stores: pa.Array) -> pa.Array:
        totals = [int(np.frombuffer(s, f"<i{s[0]}", offset=1).sum(dtype=np.int64)) for s in values(stores)]
        return pa.array(totals, pa.int64())

    return of(store)


def tokens_of_prefix(store: str | Column, n_chars: Column) -> Column:
    """The number of tokens of the first ``n_chars`` characters; of all when there are fewer, null for null or less than none."""

    @F.arrow_udf("long")
    def of(stores: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for s, n in zip(values(stores), values(lengths)):
            asked = n is not None and n >= 0
            out.append(int(np.frombuffer(s, f"<i{s[0]}", offset=1)[:n].sum(dtype=np.int64)) if asked else None)
        return pa.array(out, pa.int64())

    return of(store, n_chars.cast("long"))


def longest_prefix(store: str | Column, budget: Column) -> Column:
    """The characters of the longest prefix of at most ``budget`` tokens; null for null or a budget below none.

    Counts may fall as a prefix grows, so a longer prefix can fit where a shorter one does not.
    """

    @F.arrow_udf("long")
    def of(stores: pa.Array, budgets: pa.Array) -> pa.Array:
        out = []
        for s, most in zip(values(stores), values(budgets)):
            asked = most is not None and most >= 0
            out.append(int(np.flatnonzero(prefix_counts(s) <= most)[-1]) if asked else None)
        return pa.array(out, pa.int64())

    return of(store, budget.cast("long"))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, prefix`` of every row.

    ``prefix`` answers any later question about truncation (``longest_prefix``) or the cost of a part
    (``tokens_of_prefix``) without encoding a text again; it has a byte a character. ``path`` is a
    sentencepiece BPE model that every executor can read. Null and empty texts have no tokens and no
    bytes. Repeated rows come back as often as they came, null ids stay, other columns are not read. A
    very long text takes time in proportion to its length, and memory for its store.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        prefixes(path).alias("prefix"),
    )
    counted = rows.withColumn("n_tokens", tokens_in("prefix"))
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "prefix"
    )


def truncate(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``docs`` with every text cut to its longest prefix of at most ``budget`` tokens; other columns stay, nulls too."""
    row = docs.select(F.struct("*").alias("row"))
    cut = row.withColumn("at", longest_prefix(prefixes(path, "row.text"), F.lit(budget)))
    text = F.expr("substring(row.text, 1, cast(at as int))")
    return cut.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
