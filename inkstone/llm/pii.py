"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (strict patterns and checks) always stay. Candidates beyond them come from loose patterns: obfuscated e-mail
addresses, phone numbers without a plus sign, addresses in IPv6 form, card-like digit groups and names after a gazetteer's forms of address.
Each candidate gets votes (for, against, none) from regex, gazetteer and context labelers. Dawid-Skene
expectation-maximisation estimates a prior for each kind and each labeler's reliability from the counts of vote patterns, and a
logistic regression on the candidate's features is trained on the resulting posteriors. Candidates that it gives at
least THRESHOLD are added where they do not overlap a base span.

Votes and features are small bit patterns, so the statistics that the driver needs are the counts of (kind, pattern):
at most KINDS * 2**BITS numbers, gathered over all documents by a partial aggregate. The candidate pass writes one
small row per document; deciding reads that and never the texts again. No text is shuffled.

Defined cases: null and empty text have no spans; a very long text is scanned whole; equal starts are ordered by kind as listed in KINDS;
repeated rows give repeated results; no candidates at all train no classifier and add nothing; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._store import bound_arrow_batches, materialise

KINDS = ("email", "ip", "card", "phone", "name")
THRESHOLD = 0.9

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SPELLED = re.compile(
    r"\b[A-Za-z0-9._%+-]{2,64}(?:\s?[(\[]at[)\]]\s?[A-Za-z0-9-]{2,63}(?:\s?[(\[]dot[)\]]\s?|\s+dot\s+|\.)|\s+at\s+[A-Za-z0-9-]{2,63}(?:\s?[(\[]dot[)\]]\s?|\s+dot\s+))[A-Za-z]{2,24}\b", re.I
)
_LOOSE_PHONE = re.compile(r"(?<![\w.+-])(?:\(0?[0-9]{2,4}\)|0[0-9]{1,4})[\x20./-]?[0-9]{2,4}(?:[\x20./-]?[0-9]{2,5}){1,3}(?![\w-])")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_NAME = re.compile(r"\b(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?[\x20]([A-ZÀ-Þ][\w'-]+(?:[\x20][A-ZÀ-Þ][\w'-]+)?)")
_OBFUSCATED = re.compile(r"[(\[](?:at|dot)[)\]]|\sdot\s", re.I)

# Gazetteers: fixed lists of mail providers and domains, and of common given names in English, German, French and Spanish.
_MAIL_WORDS = frozenset("gmail googlemail yahoo ymail hotmail outlook live msn aol mail icloud me proton protonmail web gmx posteo mailbox freenet orange wanadoo laposte sfr free telefonica terra com org net edu gov de fr es uk io example".split())
_GIVEN_NAMES = frozenset("""
    james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen
    christopher nancy daniel lisa matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle
    kenneth carol kevin amanda brian dorothy george melissa edward deborah hans peter anna maria klaus ursula wolfgang monika jürgen petra
    stefan sabine andreas claudia martin julia jean marie pierre jeanne michel françoise jacques monique philippe nathalie luc sophie
    luis carmen josé antonio manuel francisca juan isabel pedro dolores javier pilar laura lucía alejandro cristina pablo elena
""".split())
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|kontakt|courriel|correo|escrib", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|master|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|whatsapp|anruf|appel|llam|teléf", re.I),
    "name": re.compile(r"dear|regards|sincerely|signed|contact|liebe|cher|estimad", re.I),
}
_AGAINST = re.compile(r"isbn|issn|version|order|page|chapter|figure|ratio|score|seite|página", re.I)
_WINDOW = 40

#: Labelers, in the order of their votes; each vote takes two bits: 0 none, 1 for, 2 against.
LABELERS = ("strict regex", "loose regex", "gazetteer", "context", "counter-context", "shape")
#: Features of the classifier, one bit each. Whether a strict pattern matched is none of them, or it would only learn that.
FEATURES = ("shape", "gazetteer", "context", "counter-context", "separators", "long", "at line start", "capital")
BITS = 2 * len(LABELERS) + len(FEATURES)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern: each at sign takes the local characters before it, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost groups of four numbers with single dots between, each at most 255; linear however long the digits run."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7 or m[0].count(".") < 3:
            continue
        parts, start, k = m[0].split("."), m.start(), 0
        while k + 4 <= len(parts):
            four = parts[k : k + 4]
            step = 4 if all(four) else 1
            if step == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, start + sum(map(len, four)) + 3))
            start += sum(len(p) + 1 for p in parts[k : k + step])
            k += step
    return out


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strict patterns, sorted."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _loose(text: str) -> list[tuple[int, int, int]]:
    out = []
    if _OBFUSCATED.search(text):
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 3, m.end()) for m in _LOOSE_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(_digits(m[0])) <= 19]
        if text.count(":") > 2:
            out += [(m.start(), 1, m.end()) for m in _IPV6.finditer(text)]
    return out + [(m.start(2), 4, m.end(2)) for m in _NAME.finditer(text)]


def candidates(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and all candidates as (start, kind, end, pattern); the pattern holds votes and features."""
    base = base_spans(text)
    if not text:
        return base, []
    strict = set(base)
    out = []
    for start, kind, end in sorted(strict | set(_loose(text))):
        span = text[start:end]
        around = text[max(0, start - _WINDOW) : start] + " " + text[end : end + _WINDOW]
        words = set(re.findall(r"[a-zà-ÿ]+", span.lower()))
        is_base = (start, kind, end) in strict
        gaze = bool(words & (_GIVEN_NAMES if kind == 4 else _MAIL_WORDS)) or (kind == 1 and span.startswith(("10.", "192.168.", "172.", "fe80", "2001"))) or (kind == 2 and span[0] in "3456")
        context, counter = bool(_CONTEXT[KINDS[kind]].search(around)), bool(_AGAINST.search(around))
        d = _digits(span)
        shape = {0: "." in span, 1: span.count(".") == 3 or ":" in span, 2: len(d) in (13, 15, 16) and luhn(d), 3: 9 <= len(d) <= 13, 4: " " in span}[kind]
        votes = (
            1 if is_base else 2 if kind in (2,) else 0,
            0 if is_base else 1,
            1 if gaze else 0,
            1 if context else 0,
            2 if counter else 0,
            1 if shape else 2,
        )
        features = (shape, gaze, context, counter, bool(re.search(r"[\x20./-]", span)), len(span) > 12, start == 0 or text[start - 1] == "\n", span[:1].isupper())
        pattern = 0
        for i, v in enumerate(votes):
            pattern |= v << (2 * i)
        for i, f in enumerate(features):
            pattern |= int(f) << (2 * len(votes) + i)
        out.append((start, kind, end, pattern))
    return base, out


def em(patterns: np.ndarray, weights: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The posterior of `true` for each vote pattern, by Dawid-Skene EM for two classes and votes of none, for or against."""
    votes = np.array([[(p >> (2 * i)) & 3 for i in range(len(LABELERS))] for p in patterns])
    said = votes > 0
    q = np.clip(0.5 + 0.25 * ((votes == 1).sum(1) - (votes == 2).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        prior = (weights @ q + 1) / (weights.sum() + 2)
        table = np.zeros((2, len(LABELERS), 3))
        for c, w in ((0, weights * (1 - q)), (1, weights * q)):
            for v in range(3):
                table[c, :, v] = w @ (votes == v)
        # pulled to the belief that a vote is right seven times in ten
        table += np.array([[4, 1, 2], [4, 4, 1]], float)[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        score = np.log(prior / (1 - prior)) + sum(np.where(said[:, i], np.log(table[1, i, votes[:, i]] / table[0, i, votes[:, i]]), 0) for i in range(len(LABELERS)))
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return q


def train(patterns: np.ndarray, targets: np.ndarray, weights: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights (bias first) of a ridge-regularised logistic regression on the feature bits, by Newton steps."""
    x = np.array([[1] + [(p >> (2 * len(LABELERS) + i)) & 1 for i in range(len(FEATURES))] for p in patterns], float)
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weights * (p - targets)) + w
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def accepted_patterns(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """The classifier's probability for each (kind, pattern) that was seen."""
    out = {}
    for kind in range(len(KINDS)):
        seen = sorted(p for k, p in counts if k == kind)
        n = np.array([counts[kind, p] for p in seen], float)
        if not seen:
            continue
        patterns = np.array(seen, np.int64)
        w = train(patterns, em(patterns, n), n)
        for p in seen:
            z = w[0] + sum(w[1 + i] for i in range(len(FEATURES)) if (p >> (2 * len(LABELERS) + i)) & 1)
            out[kind, p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return out


_SPAN = "array<struct<start:int,kind:int,end:int,pattern:int>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (strict spans) and spans (these and the ones that the classifier adds), as arrays of (start, kind, end)."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    kind = pa.struct([(x, pa.int32()) for x in ("start", "kind", "end", "pattern")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(1):
                b, c = candidates(text.as_py())
                base.append([{"start": s, "kind": k, "end": e, "pattern": 0} for s, k, e in b])
                found.append([{"start": s, "kind": k, "end": e, "pattern": p} for s, k, e, p in c])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(kind)), pa.array(found, pa.list_(kind))], names=["doc_id", "base", "found"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = materialise(source.mapInArrow(run, f"doc_id long, base {_SPAN}, found {_SPAN}"), "candidates")
    counted = seen.select(F.explode("found").alias("c")).groupBy("c.kind", "c.pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    chance = accepted_patterns({(r["kind"], r["pattern"]): r["n"] for r in counted})
    good = sorted(k * (1 << BITS) + p for (k, p), q in chance.items() if q >= THRESHOLD)

    @pandas_udf("array<struct<start:int,kind:int,end:int>>")
    def merge(base: pd.Series, found: pd.Series) -> pd.Series:
        take, out = set(good), []
        for b, c in zip(base, found, strict=True):
            spans, done = [(x["start"], x["kind"], x["end"]) for x in b], 0
            # by start; `until` is how far the base spans before each one reach
            starts = sorted(s for s, _, _ in spans)
            until = list(itertools.accumulate((e for _, _, e in sorted(spans)), max))
            for x in sorted((x for x in c if x["kind"] * (1 << BITS) + x["pattern"] in take), key=lambda x: (x["start"], x["kind"], x["end"])):
                before = bisect.bisect_left(starts, x["end"])
                if x["start"] >= done and not (before and until[before - 1] > x["start"]):
                    spans.append((x["start"], x["kind"], x["end"]))
                    done = x["end"]
            out.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted(spans)])
        return pd.Series(out, dtype=object)

    return seen.select("doc_id", "base", merge("base", "found").alias("spans"))


def _is_kind(i: int):
    return lambda x: x["kind"] == i


def _said(spans):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    """Query: personal data in all documents."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))
