"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import mul, ne
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import values, written
from leadflow.llm.decontaminate import with_text

KINDS = ["assign", "access", "hex", "random"]


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = re.compile(
    "(" + "|".join(map(_either, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16  # symbols of a token that is tested: on fewer, the three tests tell nothing apart
RUN = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)  # what holds tokens
TOKEN = re.compile("[A-Za-z0-9+/_-]{2,}(?:=+(?![A-Za-z0-9+/_-]))?")  # an inner = parts tokens, padding belongs to them
UUID = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9A-F]{8}(?:-[0-9A-F]{4}){3}-[0-9A-F]{12}")
PARTS = re.compile("[A-Za-z0-9+/]{2,}=*"), re.compile("[A-Za-z0-9_-]{2,}=*")  # of tokens that mix two alphabets' signs
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Alphabets by name, each narrower one before those that hold it: symbols in order of their value.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
LETTERS = ("lower", "UPPER", "letters", "base64", "base64url")  # those of tokens without digits
GRID = 32  # steps of a factor ten in which p-values are counted, rounded up
FLOOR = 300  # powers of ten that are told apart


def kind_of(c: str) -> int:
    """Lower case, upper case, digit or sign."""
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


PLACES = {e: {c: i for i, c in enumerate(symbols)} for e, symbols in ENCODINGS.items()}
CLASS = {c: kind_of(c) for symbols in ENCODINGS.values() for c in symbols}
CLASSES = {e: np.array([CLASS[c] for c in symbols]) for e, symbols in ENCODINGS.items()}
#: How likely two random neighbours are of different classes.
CHANGE = {e: 1 - float(((np.bincount(k) / len(k)) ** 2).sum()) for e, k in CLASSES.items()}


def infer(token: str) -> str | None:
    """The narrowest alphabet with all the symbols; None for letters alone or digits alone, which are words and numbers."""
    body = token.rstrip("=")
    if not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    symbols = set(body)
    return next((name for name, places in PLACES.items() if symbols <= places.keys()), None)


def alphabet(token: str) -> str | None:
    """The alphabet that a token is tested by: ``infer``'s, and for letters without digits one of ``LETTERS``.

    None for digits and signs without letters, and for symbols that no alphabet has together.
    """
    body = token.rstrip("=")
    if body.isalpha():
        return "lower" if body.islower() else "UPPER" if body.isupper() else "letters"
    if any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return infer(token)
    symbols = set(body)
    return next((name for name in LETTERS if symbols <= PLACES[name].keys()), None)


FAMILIES = range(2)


def family(token: str) -> int:
    """Tokens with digits or signs, and letters alone: each family's discoveries are controlled for themselves, so that
    the many long words don't hide the secrets of the other."""
    return int(token.isalpha())


@lru_cache(1 << 15)
def measures(token: str, encoding: str) -> tuple[int, float, float, float]:
    """The length, and three rates that are about 0 for symbols drawn evenly at random: the excess of chi-squared over
    all symbols, for each symbol of the token; the share of class changes that is missing; and the correlation of
    neighbours' values."""
    places, body = PLACES[encoding], token.rstrip("=")
    values = [places[c] for c in body]
    n, size = len(values), len(places)
    squares = sum(map(body.count, body)) if n < 64 else sum(x * x for x in Counter(body).values())
    chi = squares * size / n - n
    changes = 0.0
    if CHANGE[encoding]:
        classes = [CLASS[c] for c in body]
        changes = sum(map(ne, classes, classes[1:])) / (n - 1)
    total, own = sum(values), sum(map(mul, values, values))
    serial, mean = 1.0, total / n
    if own * n > total * total:
        cross = sum(map(mul, values, values[1:])) - mean * (2 * total - values[0] - values[-1]) + (n - 1) * mean * mean
        serial = cross / (own - total * mean) + 1 / n
    return n, (chi - (size - 1)) / n, CHANGE[encoding] - changes, serial


def spreads(n: int, encoding: str) -> tuple[float, float, float]:
    """The standard deviations of the three rates for random symbols: shorter tokens scatter more."""
    size, change = len(PLACES[encoding]), CHANGE[encoding]
    return (
        math.sqrt(2 * (size - 1) * (n - 1) / n) / n, math.sqrt(change * (1 - change) / (n - 1)) + 1e-9, 1 / math.sqrt(n),
    )


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, encoding: str) -> float:
    """The least p-value of the chi-squared, runs and serial-correlation tests, times three, for a token whose symbols
    are drawn evenly at random."""
    n, *rates = measures(token, encoding)
    z = [r / s for r, s in zip(rates, spreads(n, encoding))]
    return min(1.0, 3 * min(normal_tail(z[0]), 2 * normal_tail(abs(z[1])), 2 * normal_tail(abs(z[2]))))


class Null(NamedTuple):
    """What the ordinary tokens of an alphabet are like: mean of ``evenness``, and variance of one symbol's share in it."""

    mean: float
    variance: float


def log_shares(counts: np.ndarray) -> dict[str, dict[str, float]]:
    """By alphabet and symbol: log of how much more frequent the symbol is in an even alphabet than in the texts'."""
    out = {}
    for encoding, symbols in ENCODINGS.items():
        own = np.array([counts[ord(c)] + 1.0 for c in symbols])
        out[encoding] = dict(zip(symbols, np.log(own.sum() / own / len(symbols)).tolist()))
    return out


def plain_null(shares: dict[str, float]) -> Null:
    """The null of symbols that follow each other as they are frequent in the texts, each for itself."""
    x = np.array(list(shares.values()))
    often = np.exp(-x) / len(x)
    mean = float((often * x).sum())
    return Null(mean, float((often * (x - mean) ** 2).sum()))


def evenness(token: str, shares: dict[str, float]) -> float:
    """The mean of a token's log shares: low where its symbols are those that texts use, high where they are drawn evenly."""
    body = token.rstrip("=")
    return sum(map(shares.__getitem__, body)) / len(body)


@dataclass
class Ordinary:
    """Ordinary tokens by all of the corpus: log shares and null of each alphabet, and for each family where its
    tokens lie and how they scatter, in deviations of the null."""

    shares: dict[str, dict[str, float]]
    nulls: dict[str, Null]
    place: list[tuple[float, float]]

    def deviations(self, token: str, encoding: str) -> float:
        """How far a token's evenness lies above an ordinary one's of its length; longer ones scatter less."""
        mean, variance = self.nulls[encoding]
        n = len(token.rstrip("="))
        return (evenness(token, self.shares[encoding]) - mean) / math.sqrt(variance / n)

    def p_value(self, token: str, encoding: str) -> float:
        """How rarely an ordinary token of the family is as even."""
        mean, scale = self.place[family(token)]
        return normal_tail((self.deviations(token, encoding) - mean) / scale)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, stop and kind of the fixed patterns' matches, by start and then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, stop, token and alphabet of each token of at least ``LEAST`` symbols that could be an encoded value.

    A token with signs of both base64 and base64url is parted at the ones and at the others. What the fixed
    patterns leave of a token is a candidate too. The signs of a UUID don't count as symbols. What a run of symbols
    holds does not depend on the text around it.
    """
    for run in RUN.finditer(text):
        for m in TOKEN.finditer(run[0]):
            token, first = m[0], run.start() + m.start()
            if UUID.fullmatch(token):
                own = token.replace("-", "")
                if infer(own):
                    yield first, first + len(token), own, infer(own)
                continue
            found = {(0, token)}
            if not alphabet(token) and any(c in token for c in "+/") and any(c in token for c in "-_"):
                found = {(x.start(), x[0]) for part in PARTS for x in part.finditer(token)}
            at = 0
            for x in (*ACCESS.finditer(token), *HEX.finditer(token)):
                if x.start() >= at:
                    found |= {(at, token[at : x.start()]), (x.end(), token[x.end() :])}
                    at = x.end()
            for at, own in sorted(found):
                if len(own.rstrip("=")) >= LEAST and (encoding := alphabet(own)):
                    yield first + at, first + at + len(own), own, encoding


def grid_of(p: float, n: int, mean_length: float) -> int:
    """The step of the grid of a p-value weighted by length: longer tokens than the mean get a lower one."""
    if p <= 0:
        return GRID * FLOOR
    weighted = math.log10(p) - math.log10(max(n, 1) / max(mean_length, 1.0))
    return int(min(max(math.floor(-weighted * GRID), 0), GRID * FLOOR))


def _symbol_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte occurs in a task's texts."""
    n = np.zeros(256, np.int64)
    for batch in batches:
        for text in values(batch.column("text")):
            if text:
                n += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    yield pa.RecordBatch.from_pydict({"byte": pa.array(range(256), pa.int32()), "n": pa.array(n, pa.int64())})


LONG_WORD = 8  # letters of the words, too short to be tested, that tell how much more than single symbols tokens scatter
TO_RUNS = bytes(c if c in SYMBOLS else 0x20 for c in range(256))
IS_LETTER = np.array([c < 0x80 and chr(c).isalpha() for c in range(256)])


def _runs(shares: dict[str, float], mean: float):
    """A function on batches: their different runs of symbols, and in a row without a run, over their long words,
    the number and the sum of squared distances from the mean, times length."""
    share = np.zeros(256)
    for c, x in shares.items():
        share[ord(c)] = x

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squares = 0, 0.0
        for batch in batches:
            found: set[bytes] = set()
            for text in values(batch.column("text")):
                if not text:
                    continue
                data = text.encode().translate(TO_RUNS)
                found.update(w for w in data.split() if len(w) >= LEAST)
                at = np.frombuffer(data, np.uint8)
                inside = np.concatenate([[False], at != 0x20, [False]])
                edges = np.flatnonzero(inside[1:] != inside[:-1])
                starts, stops = edges[::2], edges[1::2]
                letters = np.concatenate([[0], np.cumsum(IS_LETTER[at])])
                size = stops - starts
                plain = (size >= LONG_WORD) & (size < LEAST) & (letters[stops] - letters[starts] == size)
                starts, stops = starts[plain], stops[plain]
                upto = np.concatenate([[0.0], np.cumsum(share[at])])
                size = stops - starts
                words += len(size)
                squares += float((((upto[stops] - upto[starts]) / size - mean) ** 2 * size).sum())
            runs = [w.decode() for w in found]
            yield _run_rows(runs, [0] * len(runs), [0.0] * len(runs))
        yield _run_rows([None], [words], [squares])

    return of


def _run_rows(runs: list[str | None], words: list[int], squares: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "run": pa.array(runs, pa.string()), "words": pa.array(words, pa.int64()), "squares": pa.array(squares, pa.float64()),
    })


FEW = 100  # ordinary tokens that a family needs to have a place of its own


def learn(docs: DataFrame) -> tuple[Ordinary, DataFrame, list[tuple[int, float]]]:
    """What ordinary tokens are like, by all rows; all different runs of symbols as a table; and for each family the number
    and mean length of their tokens.

    Shares come from all symbols of the texts. Words of letters tell how much more tokens scatter than single
    symbols. Tokens with digits or signs that fail as random at one in a hundred are the ordinary ones of their
    family; where there are many, their own place and scatter count.
    """
    counted = docs.select("text").mapInArrow(_symbol_counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    counts = np.zeros(256)
    for r in counted.collect():  # 256 rows
        counts[r.byte] = r.n
    shares = log_shares(counts)
    plain = {e: plain_null(x) for e, x in shares.items()}

    found = docs.select("text").mapInArrow(
        _runs(shares["letters"], plain["letters"].mean), "run string, words long, squares double"
    )
    runs = written(found.groupBy("run").agg(F.sum("words").alias("words"), F.sum("squares").alias("squares")), "runs")
    sums = runs.where("run is null").agg(F.sum("words").alias("words"), F.sum("squares").alias("squares")).first()
    wider = 1.0
    if sums.words:
        wider = max(1.0, sums.squares / sums.words / max(plain["letters"].variance, 1e-9))
    nulls = {e: Null(n.mean, max(n.variance * wider, 0.05)) for e, n in plain.items()}
    ordinary = Ordinary(shares, nulls, [(0.0, 1.0)] * len(FAMILIES))
    runs = runs.where("run is not null").select("run")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(FAMILIES), 5))
        for batch in batches:
            for run in values(batch.column("run")):
                for _, _, token, encoding in candidates(run):
                    own = sums[family(token)]
                    own[:2] += 1, len(token)
                    if randomness(token, encoding) < 0.01:
                        z = ordinary.deviations(token, encoding)
                        own[2:] += 1, z, z * z
        yield pa.RecordBatch.from_pydict({
            "family": pa.array(FAMILIES, pa.int32()), **{c: pa.array(sums[:, i]) for i, c in enumerate(FAMILY_SUMS)}
        })

    rows = runs.mapInArrow(measured, "family int, " + ", ".join(f"{c} double" for c in FAMILY_SUMS)).groupBy("family").agg(
        *[F.sum(c).alias(c) for c in FAMILY_SUMS]
    ).collect()  # one row a family
    sizes = [(0, 1.0)] * len(FAMILIES)
    for r in rows:
        sizes[r.family] = int(r.m), r.length / r.m if r.m else 1.0
        if r.family == 0 and r.ordinary >= FEW:
            mean = r.z / r.ordinary
            ordinary.place[0] = mean, max(1.0, math.sqrt(max(r.zz / r.ordinary - mean * mean, 0.0)))
    return ordinary, runs, sizes


FAMILY_SUMS = ["m", "length", "ordinary", "z", "zz"]


def step_of(token: str, encoding: str, ordinary: Ordinary, mean_length: float, doubt: float) -> int:
    """The grid step of a token's p-value; 0 where the battery says that it is not random."""
    if randomness(token, encoding) < doubt:
        return 0
    return grid_of(ordinary.p_value(token, encoding), len(token.rstrip("=")), mean_length)


@dataclass
class Battery:
    """The fitted tests: what is ordinary, and for each family the grid step from which a token of it is a discovery."""

    ordinary: Ordinary
    lengths: list[float]
    doubt: float
    steps: list[int]
    known: dict[str, list[tuple[int, int]]] = field(default_factory=dict, repr=False)  # of runs that were judged already

    def found(self, run: str) -> list[tuple[int, int]]:
        """The discoveries in a run of symbols, those that overlap as one."""
        out = self.known.get(run)
        if out is None:
            out = []
            for a, b, token, encoding in candidates(run):
                f = family(token)
                if step_of(token, encoding, self.ordinary, self.lengths[f], self.doubt) < self.steps[f]:
                    continue
                if out and a < out[-1][1]:
                    out[-1] = out[-1][0], max(b, out[-1][1])
                else:
                    out.append((a, b))
            if len(self.known) >= 30_000:
                self.known.clear()
            self.known[run] = out
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """All spans of a text, by start and then kind: the fixed patterns', and what of discoveries none of them covers."""
        if not text:
            return []
        base = base_spans(text)
        more = []
        for m in RUN.finditer(text):
            for a, b in self.found(m[0]):
                at, stop = m.start() + a, m.start() + b
                for x, y, _ in base:
                    if x < stop and at < y:
                        if at < x:
                            more.append((at, x, "random"))
                        at = y
                if at < stop:
                    more.append((at, stop, "random"))
        return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def fit(docs: DataFrame, rate: float = 0.01, doubt: float = 0.001) -> Battery:
    """The battery for ``docs``: among each family's discoveries a share of at most ``rate`` is expected to be ordinary.

    A discovery passes the three tests of randomness at level ``doubt``, and is more even than ordinary tokens.
    The rate is held over different runs of symbols, however often each occurs. P-values
    are divided by length over mean length and rounded up to a grid of 1/32 powers of ten; the
    step-up rule of Benjamini and Hochberg is then exact on counts by grid step, which are all that
    reaches the driver (at most 9,601 rows a family).
    """
    ordinary, runs, sizes = learn(docs)
    lengths = [length for _, length in sizes]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for run in values(batch.column("run")):
                for _, _, token, encoding in candidates(run):
                    f = family(token)
                    n[f, step_of(token, encoding, ordinary, lengths[f], doubt)] += 1
            yield pa.RecordBatch.from_pydict({
                "family": pa.array([f for f, _ in n], pa.int32()), "step": pa.array([s for _, s in n], pa.int64()),
                "n": pa.array(n.values(), pa.int64()),
            })

    counts = (
        runs.mapInArrow(steps, "family int, step long, n long").groupBy("family", "step").agg(F.sum("n").alias("n")).collect()
    )
    best = []
    for f in FAMILIES:
        # what the rule takes even as the only one, whether or not the corpus has such a token
        passed, own = 0, math.ceil(GRID * math.log10(max(sizes[f][0], 1) / rate))
        for row in sorted((r for r in counts if r["family"] == f), key=lambda r: -r["step"]):
            passed += row["n"]
            if row["step"] and 10 ** (-row["step"] / GRID) <= rate * passed / sizes[f][0]:
                own = min(own, row["step"])
        best.append(own)
    return Battery(ordinary, lengths, doubt, best)


SPANS = "array<struct<start:int,stop:int,kind:string>>"


def spans_column(battery: Battery, text: str | Column = "text") -> Column:
    held = SparkSession.getActiveSession().sparkContext.broadcast(battery)

    @F.arrow_udf(SPANS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = held.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            yield pa.array(
                [[{"start": a, "stop": b, "kind": k} for a, b, k in fitted.spans(t)] for t in values(batch)], kind
            )

    return of.asNondeterministic()(text)


def scan(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, spans`` of every row: start, stop (code points, exclusive) and kind of each span, by start.

    Kinds are ``assign``, ``access``, ``hex`` and, for tokens that only the tests find, ``random``. Null
    and empty texts have no spans. Repeated rows come back as often as they came, and count as often.
    """
    battery = fit(docs, **options)
    return docs.select(F.col(id_col).alias("doc_id"), spans_column(battery).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:stop of the spans, joined by commas."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def redact(docs: DataFrame, mark: str = "<secret>", **options) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping spans by one; ``n_chars`` is counted anew there.

    All rows stay, and all other columns as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The new text where there are spans, else null."""
        fitted = held.value
        for batch in batches:
            out = []
            for t in values(batch):
                parts, at = [], 0
                for start, stop, _ in fitted.spans(t):
                    if start >= at:
                        parts += [t[at:start], mark]
                    at = max(at, stop)
                out.append("".join([*parts, t[at:]]) if parts else None)
            yield pa.array(out, pa.string())

    rows = docs.select(F.struct("*").alias("row"), masked.asNondeterministic()("text").alias("new"))
    return with_text(rows, docs, F.coalesce("new", "row.text"), F.col("new").isNotNull())
