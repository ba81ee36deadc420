"""Personal data by weak supervision.

One pass over whole texts finds candidate spans and lets labelers vote on each:
the shape of the span (checksums, what numbers can be, what stands beside it),
gazetteers (domain endings, card issuers, calling and area codes, ranges of issued
numbers, given names, words that are no names) and the words before it, for or
against. Votes are 1, 0 (abstains) or -1; every labeler can vote either way on every
kind, or abstain. The distinct (kind, votes, features) patterns are counted over
all documents; their number is fixed by the labelers, not by the data, so they
may be gathered. Expectation-maximisation on the counts estimates how reliable
each labeler is for each kind and the odds of every pattern; these soft labels
train a logistic span classifier. Candidates of further kinds that it accepts, and that one
labeler at least votes for, become spans. Base spans always stay.

Defined results: a null or empty text has no spans; of candidates of further kinds
that overlap the kind listed first stays; odds of exactly ``accept`` are accepted; rows
are judged one by one, repeated rows alike (each counts); ids of any size come out as
they went in; an empty table gives an empty result and trains nothing; ``scan`` reads
doc_id and text only, and ``redact`` returns all other columns as they were. Texts are
read whole, and runs of any length cost linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_found
from .common import own_name, stored

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("local_phone", "iban", "id_number", "name")
KINDS = (*BASE_KINDS, *MORE_KINDS)
NEAR = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Gazetteers (fixed values).
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Sr", "Sra", "Señor", "Señora")
ENDINGS = frozenset("com org net edu gov mil int info biz name pro mobi app dev online site shop blog cloud email".split())
NO_ENDINGS = frozenset("example test invalid localhost local internal lan html htm php jpg png gif pdf zip exe css js".split())
CALLING = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57",
    "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29", "35",
    "37", "38", "42", "50", "59", "67", "68", "69", "85", "88", "96", "97", "99",
)
IBAN_LANDS = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MT MU NL NO PL PT QA RO RS SA SE SI SK SM TN TR UA VA XK".split())
ADVERTISED = frozenset(("078-05-1120", "219-09-9999", "457-55-5462"))
GIVEN = frozenset(
    """Adam Alan Alexander Alice Amy Ana Andrea Andrew Anna Anne Anthony Antonio Barbara Benjamin Brian Carlos Carmen Carol Catherine Charles Charlotte Chloe
    Christian Christine Claire Daniel David Deborah Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Fernando Francisco Frank Friedrich George Hannah Hans
    Heinrich Helen Henry Isabel Jack Jacob James Jan Jane Javier Jean Jennifer Jessica Johann John Jonathan Jorge Joseph José Juan Julia Julien Karen Karl Katharina
    Kevin Klaus Laura Lisa Louis Lucas Lucia Luis Manuel Marco Margaret Maria Marie Mark Martin Mary Matthew Max Michael Michel Miguel Monika Nancy Nicolas Nicole
    Olivia Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Richard Robert Rosa Ruth Samuel Sandra Sarah Sophie Stefan Stephen Susan Thomas Ursula Victor Walter William Wolfgang""".split()
)
NO_NAMES = frozenset(
    """Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December
    The This That These Those There Here When Where What Which Who How And But For From With Our Your New North South East West United States Kingdom City County
    Street Road Avenue Park River Lake Mount University College School Institute Department Company Corporation Limited Bank Group Center Museum Hotel
    License Licence Public General Creative Commons Software Foundation Source Code Form Version Terms Privacy Policy Contact About Home Page Chapter Section Table Figure""".split()
)
_PART = r"[A-ZÀ-Þ][a-zà-ÿ'-]+"
_NAME = re.compile(r"\b(?:(?:" + "|".join(TITLES) + r")\.?\x20" + _PART + r"(?:\x20" + _PART + r")?|" + _PART + r"(?:\x20" + _PART + r"){1,2})\b")
_FOR = {
    "email": re.compile(r"mail|contact|kontakt|contacto|courriel|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|visitor", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|whatsapp|anruf|appel|llam", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "id_number": re.compile(r"ssn|social|security|\bid\b|insurance", re.I),
    "name": re.compile(r"\b(?:dear|named?|name\s+(?:is|ist|was)|called|appelle|llamo|hei(?:ß|ss)e|by|signed|regards|sincerely|contact|mrs?|ms|dr|prof|patient|customer|tenant|employee)\b[\W_]*$", re.I),
}
_FOR["local_phone"] = _FOR["phone"]
_AGAINST = re.compile(r"version|release|isbn|issn|serial|order|invoice|article|model|build|\bref|sku|part\b|figure|table|chapter", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @, so that a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of further kinds outside the base spans and each other, best kind first."""
    taken = bytearray(len(text))
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    out = []
    for order, pattern in ((4, _LOCAL_PHONE), (5, _IBAN), (6, _ID), (7, _NAME)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if 1 not in taken[a:b]:
                taken[a:b] = b"\1" * (b - a)
                out.append((a, order, b))
    return out


def votes_of(text: str, start: int, order: int, end: int) -> tuple[int, int, int]:
    """Votes of shape, gazetteer and context."""
    kind, span = KINDS[order], text[start:end]
    before = text[max(0, start - NEAR) : start]
    context = 1 if _FOR[kind].search(before) else -1 if _AGAINST.search(before) else 0
    clean = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    shape, gazetteer = _VOTES[kind](span, text, start, end)
    return (shape if clean else -1), gazetteer, context


def _email(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    ending = span.rsplit(".", 1)[1].lower()
    known = 1 if ending in ENDINGS or (len(ending) == 2 and ending.isalpha()) else -1 if ending in NO_ENDINGS or ending.isdigit() else 0
    return (-1 if ".." in span or span[0] in ".-%+" else 1), known


def _ip(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    a, b, *_ = parts = [int(p) for p in span.split(".")]
    longer = text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit()
    padded = any(len(p) > 1 and p[0] == "0" for p in span.split("."))
    reserved = a in (0, 127) or a >= 240 or (a, b) == (169, 254) or parts[:3] in ([192, 0, 2], [198, 51, 100], [203, 0, 113])
    private = a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32)
    return (-1 if longer or padded else 1), (-1 if reserved else 0 if private else 1)


def _card(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    digits = _digits(span)
    groups = re.split(r"[\x20-]", span)
    even = len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]) or [len(g) for g in groups] == [4, 6, 5]
    return (1 if even and len(set(digits)) > 2 else -1), (1 if digits[0] in "23456" else -1)


def _phone(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    digits = _digits(span)
    even = span.count("(") == span.count(")") and len(set(digits[2:])) > 2
    return (1 if even else -1), (1 if digits.startswith(CALLING) else -1)


def _local_phone(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    area, exchange, line = (d := _digits(span))[:3], d[3:6], d[6:]
    shape = 1 if area[0] not in "01" and exchange[0] not in "01" else -1
    fiction = exchange == "555" and line.startswith("01")
    return shape, -1 if area[1:] == "11" or exchange[1:] == "11" or fiction else 1 if area[1] != "9" and len(set(d)) > 3 else 0


def _iban(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    body = span.replace(" ", "")
    rest = int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
    return (1 if rest == 1 and 15 <= len(body) <= 34 else -1), (1 if body[:2] in IBAN_LANDS else -1)


def _id_number(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    area, group, serial = span.split("-")
    can_be = area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"
    return (1 if can_be else -1), (-1 if span in ADVERTISED or len(set(area + group + serial)) < 3 else 1 if int(area) <= 772 else 0)


def _name(span: str, text: str, start: int, end: int) -> tuple[int, int]:
    words = span.split()
    titled = words[0].rstrip(".") in TITLES
    words = words[1:] if titled else words
    opens = text[max(0, start - NEAR) : start].rstrip(" ")[-1:] in ("", ".", "!", "?", "\n", ":", "|")
    shape = -1 if len({w.lower() for w in words}) < len(words) else 1 if titled else -1 if opens else 0
    return shape, -1 if any(w in NO_NAMES for w in words) else 1 if words[0] in GIVEN else 0


_VOTES = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "local_phone": _local_phone, "iban": _iban, "id_number": _id_number, "name": _name}


def pattern_of(text: str, start: int, order: int, end: int) -> str:
    """Votes, then features: the digits' share in fifths, the length in classes."""
    share, size = 5 * len(_digits(text[start:end])) // (end - start), min(4, (end - start) // 8)
    return ",".join(map(str, (*votes_of(text, start, order, end), share, size)))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("pattern", T.StringType())])
FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def candidates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with all candidate spans and their patterns."""

    def work(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in FOUND.names}
        for text in texts:
            base = base_spans(text)
            for i, kind in enumerate(BASE_KINDS):
                out[f"n_{kind}"].append(sum(k == i for _, k, _ in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append([{"start": a, "kind": k, "end": b, "pattern": pattern_of(text, a, k, b)} for a, k, b in base + more_spans(text, base)])
        return out

    return with_found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", FOUND, work)


@dataclass
class Reliability:
    """Of one kind: the share of true spans, and by labeler how often it votes
    -1, 0 and 1 on false and on true ones."""

    prior: float
    rates: np.ndarray  # [labeler, truth, vote + 1]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[Reliability, np.ndarray]:
    """Expectation-maximisation on counted vote patterns of one kind; also the
    posterior of each pattern. It starts from votes that are mostly right, and
    keeps them so with a little prior mass."""
    n = votes.shape[1]
    start = np.array([[0.45, 0.4, 0.15], [0.1, 0.4, 0.5]])
    prior, rates = 0.7, np.repeat(start[None], n, 0)
    for _ in range(rounds):
        logs = np.log(rates[np.arange(n), :, votes + 1])  # pattern, labeler, truth
        odds = logs[..., 1].sum(1) - logs[..., 0].sum(1) + np.log(prior / (1 - prior))
        truth = 1 / (1 + np.exp(-odds))
        weight = np.stack([(1 - truth) * counts, truth * counts])
        prior = (weight[1].sum() + 7) / (counts.sum() + 10)
        for j in range(n):
            seen = np.stack([np.bincount(votes[:, j] + 1, weights=w, minlength=3) for w in weight]) + 10 * start
            rates[j] = seen / seen.sum(1, keepdims=True)
    return Reliability(prior, rates), truth


def _vector(kind: int, pattern: str) -> np.ndarray:
    *votes, share, size = map(int, pattern.split(","))
    out = np.zeros(1 + 9 + len(KINDS) + 2)
    out[0] = 1
    for j, v in enumerate(votes):
        out[1 + 3 * j + v + 1] = 1
    out[10 + kind] = 1
    out[-2:] = share / 5, size / 4
    return out


def train(patterns: pd.DataFrame, rounds: int = 30, ridge: float = 1.0) -> np.ndarray | None:
    """patterns (kind, pattern, n) -> weights of the span classifier, by Newton
    steps on the soft labels; None without any pattern. Every pattern counts as
    often as it occurs; counts and ridge are divided by the total, which keeps the
    steps well conditioned and leaves the optimum where it is."""
    if patterns.empty:
        return None
    patterns = patterns.sort_values(["kind", "pattern"]).reset_index(drop=True)
    soft = np.zeros(len(patterns))
    for _, own in patterns.groupby("kind"):
        votes = np.array([[int(v) for v in p.split(",")[:3]] for p in own["pattern"]])
        soft[own.index] = reliabilities(votes, own["n"].to_numpy(float))[1]
    x = np.stack([_vector(k, p) for k, p in zip(patterns["kind"], patterns["pattern"], strict=True)])
    n, w = patterns["n"].to_numpy(float), np.zeros(x.shape[1])
    n, ridge = n / n.sum(), ridge / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (soft - p)) - ridge * w
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def voted_for(pattern: str) -> bool:
    """Whether any labeler votes for it; where all abstain, only the kind's prior speaks."""
    return "1" in pattern.split(",")[:3]


def accepted(found: DataFrame, accept: float = 0.5) -> set[tuple[int, str]]:
    """(kind, pattern) of further kinds that the trained classifier takes for true."""
    flat = found.select(F.explode("spans").alias("s")).select("s.kind", "s.pattern")
    patterns = flat.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()
    weights = train(patterns)
    if weights is None:
        return set()
    odds = {(k, p): 1 / (1 + np.exp(-np.clip(_vector(k, p) @ weights, -30, 30))) for k, p in zip(patterns["kind"], patterns["pattern"], strict=True)}
    return {kp for kp, v in odds.items() if kp[0] >= len(BASE_KINDS) and v >= accept and voted_for(kp[1])}


def scan(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, n_added: one row for each row of docs."""
    found = stored(candidates(docs), "pii-spans")
    few = F.array(*[F.lit(f"{k}|{p}") for k, p in sorted(accepted(found, accept))]).cast("array<string>")
    stays = F.filter("spans", lambda s: (s["kind"] < len(BASE_KINDS)) | F.array_contains(few, F.concat_ws("|", s["kind"].cast("string"), s["pattern"])))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(stays, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    text = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_base = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), (F.size(stays) - n_base).cast("long").alias("n_added"))


def redact(docs: DataFrame, taken: set[tuple[int, str]]) -> DataFrame:
    """docs with every span, base or of a pattern in ``taken``, replaced by <kind>."""

    def clean(text: str) -> str:
        base = base_spans(text)
        more = [(a, k, b) for a, k, b in more_spans(text, base) if (k, pattern_of(text, a, k, b)) in taken]
        out, at = [], 0
        for a, k, b in sorted(base + more):
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    text, new = own_name(docs, "text_"), own_name(docs, "redacted_")
    found = with_found(docs.withColumn(text, F.col("text")), text, T.StructType([T.StructField(new, T.StringType())]), lambda texts: {new: [clean(t) for t in texts]})
    whole = F.when(F.col("text").isNotNull(), F.col(new)).alias("text")
    return found.select(*[whole if c.lower() == "text" else F.col(c) for c in docs.columns])
