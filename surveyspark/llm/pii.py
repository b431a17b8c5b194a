"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans come from fixed patterns and always stay.  Further candidates are looser look-alikes of the same
kinds: numbers that look like phones without a plus, and e-mail addresses whose at sign is spelled out.  Labelers of three sorts vote on every candidate, for, against or not
at all: *regex* ones on its form, *gazetteer* ones on words beside it, and *context* ones on what surrounds it.

No labeler knows which pattern found a span.  Votes are counted over all documents by pattern and by the span's own
characters, a bounded number of kinds, so the expectation-maximisation that estimates the labelers' reliabilities runs on
counts; base spans are its known positives, spans that fail the check of their kind (card digits, parts of an address) its known
negatives.  Its posteriors train a logistic span classifier on votes, characters and
neighbours of the span, again on counts.  The classifier decides about candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.runtime import materialise

KINDS = ("email", "ip", "card", "phone")
# Characters on each side that labelers look at.
REACH = 40
# Words that stand beside personal data.
GAZETTEER = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "client", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "iban", "account", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"),
}
# Words beside numbers that are no personal data.
PLAIN = ("page", "version", "isbn", "section", "chapter", "figure", "table", "seite", "capítulo", "chapitre")
LABELERS = 6
# Yes-or-no features of a span's own characters and neighbours.
SHAPES = 9
CERTAIN = 0.9
# Spans of the fixed patterns that pass or fail the check of their kind, and candidates; what EM takes the first two for.
OPEN, GOOD, FAILED = 0, 1, 2
KNOWN = {GOOD: 0.98, FAILED: 0.02}
# Votes of each sort that false spans are taken to have beside those seen.
UNSEEN = 10

_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits fails from its second digit on exactly if it fails from its first.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{2,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]+)*"
                      r"\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z]{2,24}")
_GROUPED = re.compile(r"([0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{13,19}|(\+[0-9]{1,3} )?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in one walk over the at signs: what stands before one is the longest run since the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kept, failed) spans of the fixed patterns as (kind, start, end)."""
    kept, failed = [(0, a, b) for a, b in emails(text)], []
    for m in _IP.finditer(text):
        fine = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))
        (kept if fine else failed).append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            (kept if 13 <= len(digits) <= 19 and luhn(digits) else failed).append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            (kept if 9 <= n <= 15 else failed).append((3, *m.span()))
    return kept, failed


def candidates(text: str, kept: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser look-alikes: spelled-out addresses, phones without a plus; none that is part of a span of the fixed patterns."""
    out = []
    if "(at)" in text or "[at]" in text:
        out += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    out += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    if not out:
        return out
    taken = [(a, b) for _, a, b in (*kept, *failed)]
    return sorted(s for s in set(out) if not any(a < s[2] and s[1] < b for a, b in taken))


def well_formed(kind: int, span: str, digits: int) -> int:
    """What the form of a span says by itself, however it was found."""
    if kind == 0:
        return int(bool(_ADDRESS.fullmatch(span)))
    if kind == 1:
        return int(all(len(x) <= 3 and int(x) <= 255 for x in span.split(".")))
    if kind == 2:
        return int(13 <= digits <= 19 and luhn("".join(c for c in span if "0" <= c <= "9")))
    return 1 if 9 <= digits <= 15 else -1 if 7 <= digits <= 8 else 0


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """Six labelers, each 1 for, 0 against, -1 without opinion: two on form, two by word lists, two on what surrounds the span."""
    span = text[start:end]
    before, after = text[max(0, start - REACH):start], text[end:end + REACH]
    near = {w.lower() for w in _WORD.findall(before)[-4:]} | {w.lower() for w in _WORD.findall(after)[:2]}
    digits = sum("0" <= c <= "9" for c in span)
    grouped = -1 if kind < 2 else int(bool(_GROUPED.fullmatch(span)))
    named = 1 if near & set(GAZETTEER[KINDS[kind]]) else -1
    plain = 0 if near & set(PLAIN) else -1
    alone = 0 if (before[-1:].isalnum() and kind) or after[:1].isalnum() else 1
    in_digits = 0 if len(re.findall(r"[0-9]", before[-10:] + after[:10])) > 2 or digits > 19 else 1
    return well_formed(kind, span, digits), grouped, named, plain, alone, in_digits


def shape(text: str, start: int, end: int) -> int:
    """Characters of the span and its neighbours, one bit each."""
    span, left, right = text[start:end], text[start - 1:start] if start else "", text[end:end + 1]
    bits = ("(" in span, "." in span, "-" in span, " " in span, any(c.isalpha() for c in span), sum(c.isdigit() for c in span) >= 12,
            len(span) > 24, not left or left.isspace(), not right or right.isspace() or right in ".,;:!?)")
    return sum(1 << i for i, bit in enumerate(bits) if bit)


SPAN = "array<struct<kind:int,start:int,end:int,pattern:int,shape:int,sort:int,base:boolean>>"


def found_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and all spans of each text, with the pattern of votes."""
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(f"spans {SPAN}").fields])
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("shape", pa.int32()), ("sort", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(len(keep)):
                text = value.as_py() or ""
                kept, failed = base_spans(text)
                rows = [(s, GOOD) for s in kept] + [(s, FAILED) for s in failed] + [(s, OPEN) for s in candidates(text, kept, failed)]
                found.append([
                    {"kind": k, "start": a, "end": b, "sort": sort, "base": sort == GOOD, "shape": shape(text, a, b),
                     "pattern": sum((v + 1) * 3 ** i for i, v in enumerate(votes(text, k, a, b)))}
                    for (k, a, b), sort in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(item))], names=[*keep, "spans"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def unpacked(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(LABELERS) % 3 - 1


def reliabilities(kind: np.ndarray, pattern: np.ndarray, sort: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each (kind, pattern) after EM over the labelers' rates of voting for true and false spans.

    Candidates start from the majority of votes; spans that pass or fail the check of their kind are known.  Counts are smoothed, by one for true spans and by more for
    false ones, which are of more sorts than a corpus shows; a labeler that never votes has no say.
    """
    vote = unpacked(pattern)
    opinions = (vote >= 0).sum(axis=1)
    p = np.clip(((vote == 1).sum(axis=1) + 0.5) / (opinions + 1), 0.05, 0.95)
    for known, value in KNOWN.items():
        p[sort == known] = value
    given = p.copy()
    for _ in range(rounds):
        log = np.zeros((len(p), 2))
        prior = ((count * p).sum() + 1) / (count.sum() + 2)
        log += np.log([1 - prior, prior])
        for j in range(LABELERS):
            for truth, weight, unseen in ((1, count * p, 1), (0, count * (1 - p), UNSEEN)):
                rates = np.array([weight[vote[:, j] == v].sum() + unseen for v in (-1, 0, 1)])
                log[:, truth] += np.log(rates / rates.sum())[vote[:, j] + 1]
        p = np.where(sort != OPEN, given, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
    return p


def features(kind: np.ndarray, pattern: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Intercept, kind, votes for, votes against, characters."""
    vote = unpacked(pattern)
    return np.hstack([np.ones((len(kind), 1)), kind[:, None] == np.arange(len(KINDS))[None, :], vote == 1, vote == 0,
                      shapes[:, None] >> np.arange(SHAPES) & 1]).astype(float)


def decision(s: Column, w: np.ndarray) -> Column:
    """The classifier's score of a span, from its votes and characters."""
    k = len(KINDS)
    out = F.lit(float(w[0])) + F.element_at(F.array(*[F.lit(float(v)) for v in w[1:1 + k]]), s["kind"] + 1)
    for j in range(LABELERS):
        vote = F.floor(s["pattern"] / 3 ** j) % 3
        out = out + F.when(vote == 2, float(w[1 + k + j])).when(vote == 1, float(w[1 + k + LABELERS + j])).otherwise(0.0)
    for j in range(SHAPES):
        out = out + F.when(s["shape"].bitwiseAND(F.lit(1 << j)) > 0, float(w[1 + k + 2 * LABELERS + j])).otherwise(0.0)
    return out


def classifier(x: np.ndarray, p: np.ndarray, count: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on probabilistic labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (count * (p - q)) - ridge * w
        curve = (x * (count * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(curve, gradient)
    return w


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), certain: float = CERTAIN) -> DataFrame:
    """``keep`` columns and spans (kind, start, end, base), sorted by kind and start, of each row of ``docs``.

    Offsets count code points, ends are exclusive.  A NULL or empty text has no spans.  A candidate is added if the
    classifier is ``certain`` of it and it overlaps no base span.  Rows that repeat a doc_id are rows of their
    own.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    found = materialise(found_spans(docs, list(keep)))
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern", "s.shape", "s.sort").agg(F.count(F.lit(1)).alias("n")).collect()
    base = F.filter("spans", lambda s: s["base"])
    more = F.filter("spans", lambda s: F.lit(False))
    if any(r["sort"] == OPEN for r in counts):
        kind, pattern, shapes, sort, n = (np.array([r[i] for r in counts]) for i in range(5))
        w = classifier(features(kind, pattern, shapes), reliabilities(kind, pattern, sort, n.astype(float)), n.astype(float))
        line = float(np.log(certain / (1 - certain)))
        more = F.filter("spans", lambda s: (s["sort"] == OPEN) & (decision(s, w) >= line) & ~F.exists(
            F.filter("spans", lambda b: b["base"]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    return found.select(*keep, every.alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and n_chars, if there, counted anew.

    A NULL text stays NULL.  Other columns, whatever their names, and repeated rows stay as they are.  An empty table gives no rows.
    """
    columns = docs.columns
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    spans = personal_data(carried, ("row", "text"))
    at = F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
                     lambda s: s)
    zero = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    walk = F.aggregate(at, zero, lambda acc, s: F.struct(
        F.greatest(acc["done"], s["end"]).alias("done"),
        F.when(s["start"] < acc["done"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring("text", acc["done"] + 1, s["start"] - acc["done"]), names[s["kind"]])).alias("out")))
    rest = F.concat(F.col("walk.out"), F.substring("text", F.col("walk.done") + 1, F.length("text")))
    text = F.when(F.size("spans") > 0, rest).otherwise(F.col("text"))
    out = spans.withColumn("walk", walk).withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
           if "n_chars" in columns else None}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns])
