"""Personal data: e-mail and IP addresses, card and phone numbers, as spans of a text in code points.

Four patterns give the base spans. A semi-Markov conditional random field adds what they miss: numbers that run into
each other ("+1 (569) 555-6633 4795326016703902" is neither a phone nor a card number to a pattern), other spellings of
phone and card numbers, and addresses spelled out ("jo [at] mail [dot] org"). Its segments are whole spans, so features
may look at all of one (digits, check digit, group sizes, separators), and a dynamic program over the places where spans
may begin and end chooses boundaries and kinds together. An entity has at most MOST_TOKENS tokens.

Only islands are scored: runs of digit groups, or what stands around an "at". All else of a text can hold no entity.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, ship_package, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: The fit's bounds: texts, their characters, and islands of them.
MOST_TEXTS, MOST_CHARS, MOST_ISLANDS = 2000, 20_000, 1500
MOST_TOKENS = 10
#: Islands of made texts.
MADE = 900
SPAN = "array<struct<kind: string, start: int, end: int, base: boolean>>"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match that begins inside a run of digits would have begun at the run, so the runs are taken whole: time stays linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_ISLAND = re.compile(r"[+(]{0,2}[0-9]++(?:[ ().+/-]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)"
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s@\s?|@\s|\sat\s", re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
_SPELLED = re.compile(r"dot|[\[({<]", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in address.split(".")))


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start. A match that fails its test is dropped and not retried."""
    out, at = [], 0
    while (k := text.find("@", at)) >= 0:  # from each @ outwards, as a search from the left would cross long words again and again
        local = len(text[at:k]) - len(text[at:k].rstrip(LOCAL))
        at = k + 1
        if local and (m := _DOMAIN.match(text, k + 1)):
            out.append((EMAIL, k - local, m.end()))
            at = m.end()
    if not _DIGIT.search(text):
        return out
    out += [(IP, *m.span()) for m in _IP.finditer(text) if small_parts(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


@dataclass
class Segment:
    """Tokens first .. last of an island as an entity."""

    first: int
    last: int
    kind: int
    start: int
    end: int
    features: list[str]


@dataclass
class Island:
    tokens: int
    segments: list[Segment]


def _sides(text: str, start: int, end: int) -> list[str]:
    left, right = text[max(0, start - 2) : start], text[end : end + 2]
    out = []
    if left[-1:] in ("=", '"', "'", "#", "_", "/", "$", ":"):
        out.append("after a mark")
    if left[-1:] == "." or (left[-1:] == "," and left[:1].isdigit()):
        out.append("after a point")
    if right[:1] in (".", "-", "/", ":") and right[1:2].isalnum():
        out.append("goes on")
    if right[:1] in ("%", "$", "€", "/", "=", "_"):
        out.append("before a mark")
    return out


def _numbers(text: str, start: int, end: int) -> Island | None:
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    if sum(b - a for a, b in groups) < 7 and text.count(".", start, end) < 3:
        return None
    segments = []
    for i, (a, _) in enumerate(groups):
        if a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        digits, gaps = "", []
        for j in range(i, min(i + MOST_TOKENS, len(groups))):
            g, h = groups[j]
            if j > i:
                gaps.append(text[groups[j - 1][1] : g])
            if h - g > 19 or len(digits) + h - g > 19:
                break
            digits += text[g:h]
            if h < len(text) and (text[h].isalnum() or text[h] == "_"):
                continue
            segments += [s for make in (_phone, _card, _ip) if (s := make(text, groups, i, j, digits, gaps))]
    return Island(len(groups), segments) if segments else None


def _phone(text: str, groups: list, i: int, j: int, digits: str, gaps: list[str]) -> Segment | None:
    if not 7 <= len(digits) <= 15:
        return None
    start, end = groups[i][0], groups[j][1]
    floor = groups[i - 1][1] if i else 0
    while start > floor and text[start - 1] in "+(":
        start -= 1
    head, sizes = text[start : groups[i][0]], [b - a for a, b in groups[i : j + 1]]
    said = text[start:end]
    f = [f"{len(digits)} digits", f"{len(sizes)} groups", f"ends {'-'.join(map(str, sizes[-2:]))}", *_sides(text, start, end)]
    f += ["plus"] if head.startswith("+") else ["no plus", f"no plus, {'-'.join(map(str, sizes))}"]
    f += ["brackets"] if "(" in said and ")" in said else []
    f += ["odd brackets"] if said.count("(") != said.count(")") else []
    f += ["second plus"] if "+" in said[1:] else []
    f += ["slash"] if "/" in said else []
    f += ["one block"] if len(sizes) == 1 else []
    f += ["like an address"] if len(sizes) == 4 and all(g == "." for g in gaps) else []
    f += ["wide gap"] if any(len(g.strip(" ")) == 0 and len(g) > 1 for g in gaps) else []
    f += ["like a date"] if sizes in ([4, 2, 2], [2, 2, 4]) else []
    f += ["large group"] if max(sizes) > 8 else []
    return Segment(i, j, PHONE, start, end, f)


def _card(text: str, groups: list, i: int, j: int, digits: str, gaps: list[str]) -> Segment | None:
    if not 13 <= len(digits) <= 19 or any(g not in (" ", "-", ".") for g in gaps):
        return None
    start, end, sizes = groups[i][0], groups[j][1], [b - a for a, b in groups[i : j + 1]]
    f = [f"{len(digits)} digits", "check digit" if luhn(digits) else "no check digit", f"begins {digits[0]}", *_sides(text, start, end)]
    f += [f"sizes {'-'.join(map(str, sizes))}" if sizes in ([16], [4, 4, 4, 4], [4, 6, 5], [15]) else "other sizes", f"{len(set(gaps))} separators"]
    f += ["after plus"] if start and text[start - 1] in "+(" else []
    f += ["even"] if len(set(digits)) <= 2 else []
    return Segment(i, j, CARD, start, end, f)


def _ip(text: str, groups: list, i: int, j: int, digits: str, gaps: list[str]) -> Segment | None:
    if j - i != 3 or any(g != "." for g in gaps):
        return None
    start, end = groups[i][0], groups[j][1]
    parts = [text[a:b] for a, b in groups[i : j + 1]]
    f = ["small parts" if small_parts(".".join(parts)) else "large parts", *_sides(text, start, end)]
    f += ["leading zero"] if any(len(p) > 1 and p[0] == "0" for p in parts) else []
    f += ["begins 0"] if parts[0] == "0" else []
    f += ["single digits"] if max(map(len, parts)) == 1 else []
    return Segment(i, j, IP, start, end, f)


def _spelled(text: str, at: re.Match) -> Island | None:
    """The island around an "at": the local part is its first token, the labels of the domain are the others."""
    head = text[max(0, at.start() - 64) : at.start()]
    local = len(head) - len(head.rstrip(LOCAL))
    m = _LABELS.match(text, at.end())
    if not local or not m or (at[0].strip().lower() == "at" and not _SPELLED.search(m[0])):
        return None
    start, pieces = at.start() - local, [p.span() for p in re.finditer(_DOT, m[0], re.I)]
    ends = [at.end() + a for a, _ in pieces[1:]] + [m.end()]
    segments = []
    for n, end in enumerate(ends[: MOST_TOKENS - 2]):
        if end < len(text) and text[end].isalnum():
            continue
        said = text[at.end() : end]
        last = re.split(_DOT, said, flags=re.I)[-1]
        f = ["bracketed at" if at[0].strip()[:1] in "[({<" else "at" if "@" not in at[0] else "@", f"{n + 2} labels", *_sides(text, start, end)]
        f += ["bracketed dot"] if re.search(r"[\[({<]", said) else ["spelled dot"] if re.search(r"\sdot\s", said, re.I) else ["dot"]
        f += ["letters end"] if last.isalpha() and 2 <= len(last) <= 6 else ["odd end"]
        f += ["more labels"] if end != ends[-1] else ["all labels"]
        f += ["short local"] if local < 2 else []
        f += ["digits in local"] if any(c.isdigit() for c in text[start : at.start()]) else []
        segments.append(Segment(0, n + 2, EMAIL, start, end, f))
    return Island(len(ends) + 2, segments) if segments else None


def islands(text: str) -> Iterator[Island]:
    """Where entities can lie. Time grows with the text: every part of it is looked at a bounded number of times."""
    if _DIGIT.search(text):
        for m in _ISLAND.finditer(text):
            if m.end() - m.start() >= 7 and (found := _numbers(text, *m.span())):
                yield found
    if "@" in text or "at" in text.lower():
        for at in _AT.finditer(text):
            if found := _spelled(text, at):
                yield found


OUTSIDE = len(KINDS)


@dataclass
class Model:
    """A weight per kind and feature, and per pair of neighbouring kinds (OUTSIDE last)."""

    weights: dict[str, float]
    follows: list[list[float]]

    def score(self, s: Segment) -> float:
        known, kind = self.weights.get, KINDS[s.kind]
        return known(kind, 0.0) + sum(known(f"{kind} {f}", 0.0) for f in s.features)

    def decode(self, island: Island) -> list[Segment]:
        """The best segmentation: the best score of each place and last kind, and how it came about."""
        ending: list[list[Segment]] = [[] for _ in range(island.tokens)]
        for s in island.segments:
            ending[s.last].append(s)
        low = float("-inf")
        best = [[low] * OUTSIDE + [0.0]]
        back: list[list] = [[None] * (OUTSIDE + 1)]
        for t in range(island.tokens):
            now, how = [low] * (OUTSIDE + 1), [None] * (OUTSIDE + 1)
            for s, kind, first, own in [(None, OUTSIDE, t, 0.0)] + [(s, s.kind, s.first, self.score(s)) for s in ending[t]]:
                for before in range(OUTSIDE + 1):
                    value = best[first][before] + self.follows[before][kind] + own
                    if value > now[kind]:
                        now[kind], how[kind] = value, (s, first, before)
            best.append(now), back.append(how)
        at, kind, out = island.tokens, max(range(OUTSIDE + 1), key=lambda k: best[-1][k]), []
        while back[at][kind]:
            s, at_, kind_ = back[at][kind]
            out += [s] if s else []
            at, kind = at_, kind_
        return out[::-1]


def spans(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind, then start. Segments that meet a base span take no part in the decoding."""
    base = base_spans(text)
    held = sorted((a, b) for _, a, b in base)
    starts, reach, far = [a for a, _ in held], [], 0
    for _, b in held:
        reach.append(far := max(far, b))

    def free(s: Segment) -> bool:
        k = bisect.bisect_left(starts, s.end)  # those that begin before the segment ends: does any reach into it?
        return not k or reach[k - 1] <= s.start

    added, end = [], 0
    for island in islands(text):
        island.segments = [s for s in island.segments if free(s)]
        added += [(s.kind, s.start, s.end, False) for s in model.decode(island)] if island.segments else []
    out, taken = [], []
    for kind, a, b, _ in sorted(added, key=lambda x: (x[1], -x[2])):  # islands of digits and of words may meet
        if a >= end:
            taken.append((kind, a, b, False))
            end = b
    out = [(k, a, b, True) for k, a, b in base] + taken
    return sorted(out)


# --- learning -------------------------------------------------------------------------------------------------------


def _number(rng: np.random.Generator, n: int) -> str:
    return str(rng.integers(1, 10)) + "".join(map(str, rng.integers(0, 10, n - 1)))


def _with_check_digit(rng: np.random.Generator, n: int) -> str:
    head = str(rng.choice([3, 4, 5, 6])) + "".join(map(str, rng.integers(0, 10, n - 2)))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _made(rng: np.random.Generator) -> tuple[int, str]:
    """An entity in one of its spellings, or (OUTSIDE, something alike)."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    kind = pick(PHONE, PHONE, CARD, IP, EMAIL, OUTSIDE, OUTSIDE, OUTSIDE)
    if kind == PHONE:
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        country = pick("1", "44", "49", "33", "34", "351")
        return kind, pick(f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{country}{a}{b}{c}", f"+{country} {a}{b}{c}")
    if kind == CARD:
        d = _with_check_digit(rng, 16)
        fours = [d[i : i + 4] for i in range(0, 16, 4)]
        return kind, pick(d, d, " ".join(fours), "-".join(fours), ".".join(fours))
    if kind == IP:
        return kind, ".".join(map(str, rng.integers(0, 256, 4) if rng.random() < 0.8 else rng.integers(100, 256, 4)))
    if kind == EMAIL:
        word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
        local, domain, top = pick(word(), f"{word()}.{word()}", f"{word()}{rng.integers(99)}"), pick(word(), f"mail{rng.integers(9)}"), pick("com", "org", "net", "de", "fr", "io")
        at, dot = pick((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), ("[@]", "[.]"))
        return kind, local + at + pick(domain, domain + dot + word()) + dot + top
    while True:
        d = _number(rng, 16)
        if not luhn(d):
            break
    fours = [d[i : i + 4] for i in range(0, 16, 4)]
    y, m, n = rng.integers(1900, 2100), rng.integers(1, 13), rng.integers(1, 29)
    return OUTSIDE, pick(
        d, " ".join(fours), "-".join(fours), _number(rng, int(rng.integers(7, 16))), f"{y}-{m:02}-{n:02}", f"{n:02}.{m:02}.{y}", f"{m:02}/{n:02}/{y}", f"{y}-{m:02}-{n:02} {n:02}",
        ".".join(map(str, rng.integers(0, 12, int(rng.integers(5, 7))))), ".".join(map(str, rng.integers(256, 999, 4))), f"{y}-{y + 1}", f"{_number(rng, 5)}-{_number(rng, 4)}", f"{_number(rng, 2)} {_number(rng, 3)} {_number(rng, 3)}",
        f"look @ {_number(rng, 2)}.5", "be at the (dot) place", _number(rng, 25), f"{_number(rng, 3)} {_number(rng, 4)}", f"{_number(rng, 3)}-{_number(rng, 2)}-{_number(rng, 4)}",
    )


def examples(rng: np.random.Generator, n: int) -> list[tuple[Island, list[tuple[int, int, int]]]]:
    """Islands of made texts with their true spans: entities and lookalikes, alone or side by side."""
    out = []
    while len(out) < n:
        text, true = "the word ", []
        for _ in range(int(rng.integers(1, 4))):
            kind, said = _made(rng)
            if kind != OUTSIDE:
                true.append((kind, len(text), len(text) + len(said)))
            text += said + (" " if rng.random() < 0.7 else ", then ")
        out += [(i, true) for i in islands(text + "and more.")]
    return out[:n]


def observed(text: str | None) -> list[tuple[Island, list[tuple[int, int, int]]]]:
    """A text's islands with the base spans in them; none where a base match failed its test, since an entity may hide there."""
    text = text or ""
    base, out = base_spans(text), []
    failed = [m.span() for p in (_CARD, _PHONE) for m in p.finditer(text) if m.end() - m.start() >= 9 and not any(a == m.start() and b == m.end() for _, a, b in base)]
    for island in islands(text):
        a, b = min(s.start for s in island.segments), max(s.end for s in island.segments)
        if not any(x < b and a < y for x, y in failed):
            out.append((island, [s for s in base if s[1] < b and a < s[2]]))
    return out


def train(real: list[tuple[Island, list[tuple[int, int, int]]]], made: int = MADE, seed: int = 11, steps: int = 30, rate: float = 0.4, pull: float = 2e-3) -> Model:
    """Maximum likelihood by Adagrad over real and made islands; `pull` draws weights to 0.

    Expected features come from a forward and a backward pass over each island. An island whose true spans are none of
    its segments takes no part.
    """
    names: dict[str, int] = {}
    data = []
    for island, true in [*real, *examples(np.random.default_rng(seed), made)]:
        a, b = min(s.start for s in island.segments), max(s.end for s in island.segments)
        wanted = {t for t in true if t[1] < b and a < t[2]}
        gold = [n for n, s in enumerate(island.segments) if (s.kind, s.start, s.end) in wanted]
        if len(gold) != len(wanted):
            continue
        rows = [[names.setdefault(KINDS[s.kind], len(names)), *(names.setdefault(f"{KINDS[s.kind]} {f}", len(names)) for f in s.features)] for s in island.segments]
        data.append((island, rows, sorted(gold, key=lambda n: island.segments[n].first)))
    flat = np.array([f for _, rows, _ in data for r in rows for f in r], int)
    lengths = np.array([len(r) for _, rows, _ in data for r in rows], int)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    w, follows = np.zeros(len(names)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    gw, gf = np.full_like(w, 1e-6), np.full_like(follows, 1e-6)
    n = max(1, len(data))
    for _ in range(steps):
        scores = np.bincount(owner, w[flat], len(lengths)) if len(lengths) else np.empty(0)
        weight, df, at = np.zeros(len(lengths)), np.zeros_like(follows), 0
        for island, rows, gold in data:
            expected = _expect(island, scores[at : at + len(rows)], follows, df)
            weight[at : at + len(rows)] = expected
            before, place = OUTSIDE, 0
            for g in gold:
                s = island.segments[g]
                weight[at + g] -= 1
                for kind in [OUTSIDE] * (s.first - place) + [s.kind]:
                    df[before, kind] -= 1
                    before = kind
                place = s.last + 1
            for _ in range(island.tokens - place):
                df[before, OUTSIDE] -= 1
                before = OUTSIDE
            at += len(rows)
        dw = np.bincount(flat, weight[owner], len(w)) / n + pull * w if len(flat) else w * 0
        df = df / n + pull * follows
        gw += dw * dw
        gf += df * df
        w -= rate * dw / np.sqrt(gw)
        follows -= rate * df / np.sqrt(gf)
    return Model({k: float(w[v]) for k, v in names.items()}, follows.tolist())


def _expect(island: Island, scores: np.ndarray, follows: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Each segment's probability; adds those of neighbouring kinds to df."""
    n, low = island.tokens, -1e30
    edges = [(t, t + 1, OUTSIDE, 0.0, -1) for t in range(n)] + [(s.first, s.last + 1, s.kind, float(scores[k]), k) for k, s in enumerate(island.segments)]
    alpha, beta = np.full((n + 1, OUTSIDE + 1), low), np.full((n + 1, OUTSIDE + 1), low)
    alpha[0, OUTSIDE], beta[n] = 0.0, 0.0
    for a, b, kind, own, _ in sorted(edges, key=lambda e: e[1]):
        alpha[b, kind] = np.logaddexp(alpha[b, kind], np.logaddexp.reduce(alpha[a] + follows[:, kind]) + own)
    for a, b, kind, own, _ in sorted(edges, key=lambda e: -e[0]):
        beta[a] = np.logaddexp(beta[a], follows[:, kind] + own + beta[b, kind])
    total, out = np.logaddexp.reduce(alpha[n]), np.zeros(len(scores))
    for a, b, kind, own, k in edges:
        p = np.exp(np.minimum(alpha[a] + follows[:, kind] + own + beta[b, kind] - total, 0.0))
        df[:, kind] += p
        if k >= 0:
            out[k] = p.sum()
    return out


# --- in Spark -------------------------------------------------------------------------------------------------------


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learns from islands of some MOST_TEXTS different texts of at most MOST_CHARS characters, with their base spans as
    labels, at most MOST_ISLANDS of them, and from made spellings. Empty tables leave the made ones.

    Texts are picked by a hash below the share that gives as many, so tasks find theirs alone; only islands, some hundred
    bytes each, come to the driver.
    """
    ship_package(docs.sparkSession)
    bits = 1 << 31
    share = min(1.0, MOST_TEXTS / max(1, docs.count()))
    hashed = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(13)), F.lit(bits))
    picked = docs.where((F.char_length(text) <= MOST_CHARS) & (hashed < int(share * bits))).select(F.col(text).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps([island.tokens, [vars(s) for s in island.segments], base]) for x in batch.column(0).to_pylist() for island, base in observed(x)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["island"])

    rows = picked.mapInArrow(run, "island string").orderBy(F.xxhash64("island"), "island").limit(MOST_ISLANDS).collect()
    return train([(Island(tokens, [Segment(**s) for s in segments]), [tuple(b) for b in base]) for tokens, segments, base in (json.loads(r.island) for r in rows)])


def find(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, an array of (kind, start, end, base) by kind, then start: a row per row of docs.

    A null text is empty and has none; repeated rows have the same spans; whole texts are searched, in time in proportion
    to their length; other columns are ignored. Base spans of different kinds may overlap; added spans overlap nothing.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in slices(batches, "text"):
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans(x or "", sent.value)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, kind)], ["key", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(released(run), f"key {dict(docs.dtypes)[key]}, spans {SPAN}").withColumnRenamed("key", key)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans, all of them; n_added, of the others."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select(key, *map(count, KINDS), F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), added)
