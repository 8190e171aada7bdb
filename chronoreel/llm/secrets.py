"""Secret scans: fixed rules, and character Markov models for what no rule names.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are trained
from labelled samples: generated ones, and those that ``samples`` draws from the texts themselves, where the
rules label the strings (what a rule found is random, other words are ordinary). A candidate is the part of a
run of [A-Za-z0-9+/_=-], cut at its delimiters, with the largest log-likelihood ratio, such as the key in a
path; it is a secret if it has LEAST characters and its ratio is high enough in all and for each character,
with higher limits for letters only. A run can hold several. Digits alone, and identifiers of a known shape,
are none. Spans of the rules always stay; runs that overlap one are left to the rules.

Defined cases: a null text counts as empty and has no spans; offsets are code points, ends exclusive;
repeated rows and null ids are scanned row by row; an empty table gives no rows; other columns are
ignored by ``scan``. ``redact`` keeps every row and column, null texts stay null. Time is linear in the length
of a text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, so the same as runs of any length of which 32 or more stay
KINDS = ("assign", "access", "hex", "markov")

LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PIECE = re.compile(r"[A-Za-z0-9]+|[+/_=-]+")
SHAPED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")  # identifiers of public use
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# Words from which ordinary identifiers are put together.
WORDS = (
    "access account action active address agent array batch buffer build button cache callback channel "
    "check client cluster code column command config connection content context controller counter cursor "
    "data default delete device document driver element engine error event executor factory field file "
    "filter folder format frame function group handler header image index input instance interface item "
    "iterator label language layout length level library limit listener loader manager mapping message "
    "method metric model module name network node number object offset option output package page parameter "
    "parser partition password path pattern pointer policy position process profile project property "
    "protocol provider query queue reader record reference region registry report request resource response "
    "result router schema scope search segment sequence server service session setting shard signal size "
    "source stack state status storage stream string style summary switch system table target task template "
    "thread timer token topic trace type update value vector version view window worker wrapper writer"
).split()


def labelled_samples(seed: int = 11, each: int = 4000) -> list[tuple[str, bool]]:
    """(string, is random): generated strings of common secret alphabets, and identifiers made of WORDS."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", CHARS[:62], CHARS[:62] + "+/", CHARS[:26] + CHARS[52:62], CHARS[26:62], CHARS[:62] + "_-", CHARS[:52])
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))), True) for _ in range(each)]
    for _ in range(each):
        words = rng.choices(WORDS, k=rng.randint(2, 6))
        shape = rng.randrange(7)
        number = str(rng.randrange(10 ** rng.randint(1, 8)))
        if shape == 0:
            text = words[0] + "".join(w.title() for w in words[1:]) + rng.choice(("", number))
        elif shape == 1:
            text = "_".join(words).upper() + rng.choice(("", "_" + number))
        elif shape == 6:
            text = rng.choice(("", "-")).join(str(rng.randrange(10**4)).zfill(4) for _ in range(6))
        else:
            text = "_-/ ="[shape - 2 : shape - 1].strip().join([*words, number] if rng.random() < 0.5 else words)
        out.append((text, False))
    return out


class RandomStrings:
    """Log-likelihood ratio of a first-order Markov model of random strings to one of identifiers.

    ``counted``: more samples as (is random, string, times). ``least`` and ``least_mean`` are limits of the
    ratio, in all and for each character: of strings with letters and digits, and of letters only.
    """

    def __init__(
        self,
        samples: Iterable[tuple[str, bool]] | None = None,
        least: tuple[float, float] = (9.0, 20.0),
        least_mean: tuple[float, float] = (0.5, 0.9),
        counted: Iterable[tuple[bool, str, int]] = (),
    ):
        self.least, self.least_mean = least, least_mean
        n = len(CHARS) + 1  # the last stands for the start
        at = {c: i for i, c in enumerate(CHARS)}
        counts = {True: [[0.5] * (n - 1) for _ in range(n)], False: [[0.5] * (n - 1) for _ in range(n)]}
        for text, label in samples if samples is not None else labelled_samples():
            last = n - 1
            for c in text:
                if c in at:
                    counts[label][last][at[c]] += 1
                    last = at[c]
        for label, pair, times in counted:  # one or two characters; one is the first of a string
            counts[label][at[pair[0]] if len(pair) > 1 else n - 1][at[pair[-1]]] += times
        self.gain = {}
        for i in range(n):
            a, b = (sum(counts[k][i]) for k in (True, False))
            for c, j in at.items():
                self.gain[(CHARS[i] if i < n - 1 else "") + c] = math.log(counts[True][i][j] / a) - math.log(counts[False][i][j] / b)

    def ratio(self, text: str) -> float:
        return self.gain[text[0]] + sum(self.gain[text[i : i + 2]] for i in range(len(text) - 1))

    def is_secret(self, text: str) -> bool:
        bare = not any(map(str.isdigit, text))
        if len(text) < LEAST or not any(map(str.isalpha, text)) or SHAPED.fullmatch(text):
            return False
        found = self.ratio(text)
        return found >= self.least[bare] and found >= self.least_mean[bare] * len(text)

    def spans(self, run: str) -> Iterator[tuple[int, int]]:
        """Secrets inside a run: of its pieces, the neighbours whose ratio is furthest above the limit.

        What is left before them is cut off by a ratio that has fallen below the limit, so one pass finds all.
        """
        mean = self.least_mean[0]
        begin, best, total, top = 0, 0, 0.0, 0.0
        for m in PIECE.finditer(run):
            gain = sum(self.gain[run[i - 1 : i + 1] if i > begin else run[i]] - mean for i in range(m.start(), m.end()))
            total += gain
            if m[0][0].isalnum() and total > top:
                best, top = m.end(), total
            if total < 0 or total < top - self.least[0]:
                if best > begin and self.is_secret(run[begin:best]):
                    yield begin, best
                begin = best = m.end()
                total = top = 0.0
            elif total == gain and not m[0][0].isalnum():  # a span does not begin with a delimiter
                begin = best = m.end()
                total = top = 0.0
        if best > begin and self.is_secret(run[begin:best]):
            yield begin, best


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the rules find, in order."""
    low, out = text.lower(), []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def free_runs(text: str, rules: list[tuple[int, int, int]], pattern: re.Pattern) -> Iterator[re.Match]:
    """Matches of ``pattern`` that overlap no rule's span; both lists are walked once."""
    at = reach = 0
    for m in pattern.finditer(text):
        while at < len(rules) and rules[at][0] < m.end():
            reach = max(reach, rules[at][2])
            at += 1
        if reach <= m.start():
            yield m


def find(text: str, model: RandomStrings) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every span, in order."""
    rules = rule_spans(text)
    more = [(m.start() + a, 3, m.start() + b) for m in free_runs(text, rules, CANDIDATE) for a, b in model.spans(m[0])]
    return sorted(rules + more) if more else rules


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 2000) -> DataFrame:
    """(random, pair, n): how often two characters follow each other, and which come first, in labelled strings.

    Of about ``max_rows`` rows, drawn by a hash of the id (of the text where it is null), the rules label the strings: the values that they
    find are random strings, other words that begin with a letter are ordinary.
    """
    share = min(1.0, max_rows / max(1, docs.count()))
    # Rows without an id are drawn by their text, or all of them would be drawn or none.
    drawn = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("samples"), F.col(text_col).cast("string"))).otherwise(F.xxhash64(F.lit("samples"), F.col(id_col)))
    drawn = F.pmod(drawn, F.lit(1 << 30)) < F.lit(round(share * (1 << 30)))
    word = re.compile(r"[A-Za-z][A-Za-z0-9+/_=-]{3,}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 128, 128), np.int64)  # by label, character before (a line break for none) and character
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py()
                rules = rule_spans(text)
                strings = [(ASSIGN.fullmatch(text[a:b])[2] if k == 0 else text[a:b]).replace(".", "") for a, k, b in rules]
                for label, found in ((1, strings), (0, [m[0] for m in free_runs(text, rules, word)])):
                    codes = np.frombuffer("\n".join(["", *found]).encode("ascii"), np.uint8)
                    if len(codes):
                        last, now = codes[:-1].astype(np.int64), codes[1:]
                        seen[label] += np.bincount((last * 128 + now)[now != 10], minlength=128 * 128).reshape(128, 128)
        label, last, now = (x.tolist() for x in np.nonzero(seen))
        pairs = [("" if a == 10 else chr(a)) + chr(b) for a, b in zip(last, now, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([bool(x) for x in label], pa.bool_()), pa.array(pairs, pa.string()), pa.array(seen[label, last, now], pa.int64())], ["random", "pair", "n"])

    texts = docs.where(drawn).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return texts.mapInArrow(count, "random boolean, pair string, n long").groupBy("random", "pair").agg(F.sum("n").alias("n"))


def train(counts: DataFrame) -> RandomStrings:
    """Models from generated samples and a table of ``samples``, which has at most two rows a pair of characters."""
    return RandomStrings(counted=[(r["random"], r["pair"], r["n"]) for r in counts.collect()])


def _joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RandomStrings | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts by kind, the digest of the rules' spans, all spans."""
    model = model or RandomStrings()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                spans = find(text, model)
                kinds = [k for _, k, _ in spans]
                base = _joined(x for x in spans if x[1] < 3)
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            found = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])
            found.insert(0, "doc_id", pdf["doc_id"])
            yield found

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(look, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redacted(text: str, model: RandomStrings, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, _, b in find(text, model):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if at else text


def redact(docs: DataFrame, text_col: str = "text", model: RandomStrings | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``find`` replaced by ``mark``; overlapping spans become one mark."""
    model = model or RandomStrings()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t, model, mark))

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
