"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans of four kinds, which may overlap. Base rules keep theirs for sure: a regular
expression, leftmost and non-overlapping, and a test of the match. What base rules drop and what further generators
propose is scored by boosted trees over the candidate's format and context; those above their kind's threshold and
free of base spans of their kind are added. The trees are fitted here, on made-up sentences run through the same
expressions, and the thresholds are calibrated on others.

Positions count code points, ends are exclusive. Defined results: a null text counts as empty and has no spans; texts of
any length are read whole; repeated rows get the same spans each; columns other than the text aren't looked at.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base rules' expressions. Repetitions that can't give back anything are possessive.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Where a match can start unless it starts where the last one ended: this keeps the search linear.
STARTS = {"email": r"(?<![A-Za-z0-9._%+-])", "ip": r"(?<![0-9])", "card": r"(?<![0-9])", "phone": ""}
#: Further generators, by kind.
MORE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?:[0-9]{1,3}+(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,3}+){3}|[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){4,7}+)(?![0-9A-Za-z:])",
    "card": r"[0-9]{4}(?:[\x20.-]?(?:[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}|[0-9]{6}[\x20.-]?[0-9]{5}))(?![0-9])",
    "phone": r"(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20./-][0-9]{2,5}){2,4}|0[1-9][0-9]{1,3}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4})(?![0-9])",
}
MORE_STARTS = {"email": r"(?<![A-Za-z0-9._%+-])", "ip": r"(?<![0-9A-Za-z.:])", "card": r"(?<![0-9])", "phone": r"(?<![0-9+(])"}
#: A text is searched for a kind only if it has this.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
MORE_GATES = {"email": r"[\[(]at[\])]", "ip": r"[0-9]\x20?[\[(](?:\.|dot)[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20.-]?[0-9]{4}", "phone": r"[0-9]{3}[\x20./-][0-9]{2}|[0-9]{2}[\x20./-][0-9]{3}"}
#: Words before a candidate that speak for or against it.
CONTEXT = {
    "says_phone": r"phone|tel|call|mobile|cell|fax|reach|whatsapp|contact",
    "says_card": r"card|visa|master|amex|credit|debit|payment|paid",
    "says_email": r"mail|write|contact|reach|address",
    "says_ip": r"\bip\b|server|host|login|client|address",
    "says_other": r"version|release|order|invoice|isbn|serial|ticket|page|figure|section|ratio|score|build|sku|part",
}
#: Characters before a candidate that count as its context.
CONTEXT_CHARS = 40
#: Elements that a running total over an array takes at a time.
SCAN_CHUNK = 128
#: Characters of a text that a piece of it is cut from.
CUT_CHARS = 4096

FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "chars", "digits", "luhn", "separators", "brackets", "colons", "groups", "glued_before", "glued_after", *CONTEXT)
SPAN = "array<struct<start:bigint,end:bigint>>"


# Expressions are SQL text: they are long, and built from Column objects they take seconds to plan.


def _matches(pattern: str, start: str, gate: str) -> str:
    """For each match in `text` the text since the end of the last one, itself included."""
    whole = rf"(?s)\G(?:.*?{start})??(?:{pattern})"
    return f"if(text rlike r'{gate}', regexp_extract_all(text, r'{whole}', 0), cast(array() as array<string>))"


def _let(name: str, body: str, **values: str) -> str:
    """The body over a struct of values, each computed once however often the body's lambdas use it."""
    return f"transform(array(named_struct({', '.join(f"'{n}', {v}" for n, v in values.items())})), {name} -> {body})[0]"


def _sum(a: str, x: str) -> str:
    return f"{a} + {x}"


def _most(a: str, x: str) -> str:
    return f"greatest({a}, {x})"


def _running(xs: str, add=_sum, zero: int = 0) -> str:
    """The running totals of an array of bigint, by an associative function. Chunks are totalled first, so the work grows
    with the array (and, beyond some hundred thousand elements, slowly with its square)."""

    def total(part: str) -> str:
        return f"aggregate({part}, {zero}L, (t, y) -> {add('t', 'y')})"

    def chunks(xs: str, body: str) -> str:
        return f"transform(sequence(0, cast(floor((size({xs}) - 1) / {SCAN_CHUNK}) as int)), c -> {body})"

    inside = f"transform(sequence(1, least({SCAN_CHUNK}, size(r3.xs) - c * {SCAN_CHUNK})), k -> {add('r3.bases[c]', total(f'slice(r3.xs, c * {SCAN_CHUNK} + 1, k)'))})"
    totals = f"flatten({chunks('r3.xs', inside)})"
    with_bases = _let("r3", totals, xs="r2.xs", bases=chunks("r2.xs", total("slice(r2.sums, 1, c)")))
    with_sums = _let("r2", with_bases, xs="r1.xs", sums=chunks("r1.xs", total(f"slice(r1.xs, c * {SCAN_CHUNK} + 1, {SCAN_CHUNK})")))
    return f"if(size({xs}) > 0, {_let('r1', with_sums, xs=xs)}, cast(array() as array<bigint>))"


def _spans(segments: str, pattern: str, start: str) -> str:
    """Structs of start, end, the matched string, the context before it and the character after it."""
    before = f"substr(m.segment, greatest(1, char_length(m.segment) - char_length(m.found) - {CONTEXT_CHARS} + 1), least({CONTEXT_CHARS}, char_length(m.segment) - char_length(m.found)))"
    # the next segment starts where this match ends
    after = "if(i + 1 < size(v.segments), substr(v.segments[i + 1], 1, 1), v.last)"
    span = f"named_struct('start', m.end - char_length(m.found), 'end', m.end, 'found', m.found, 'before', {before}, 'after', m.after)"
    one = _let("m", span, segment="s", found=rf"regexp_extract(s, r'{start}(?:{pattern})\z', 0)", end="v.ends[i]", after=after)
    every = f"transform(v.segments, (s, i) -> {one})"
    last = _let("v", every, segments="w.segments", ends="w.ends", last="substr(text, cast(element_at(w.ends, -1) + 1 as int), 1)")
    lengths = f"transform({segments}, x -> cast(char_length(x) as bigint))"
    return f"if(size({segments}) > 0, {_let('w', last, segments=segments, ends=_running(lengths))}, cast(array() as array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>))"


def _passes(kind: str) -> str:
    """The base rules' tests of a candidate c."""
    digits = "regexp_replace(c.found, '[^0-9]', '')"
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": "true", "ip": rf"c.found rlike r'^{part}\.{part}\.{part}\.{part}$'",
        "card": f"(length({digits}) between 16 and 19 and luhn_check({digits}))", "phone": f"length({digits}) between 8 and 15",
    }[kind]


def find_candidates(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document the base spans (base_KIND) and the other candidates (more_KIND) as arrays of structs; narrow."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    rules = [(f"b_{k}", BASE[k], STARTS[k], GATES[k]) for k in KINDS] + [(f"m_{k}", MORE[k], MORE_STARTS[k], MORE_GATES[k]) for k in MORE]
    # one step after another: what a later step uses several times is computed once
    df = df.withColumns({f"seg_{n}": F.expr(_matches(p, s, g)) for n, p, s, g in rules})
    df = df.withColumns({f"sp_{n}": F.expr(_spans(f"seg_{n}", p, s)) for n, p, s, _ in rules})
    kept = [f"filter(sp_b_{k}, c -> {_passes(k)}) as base_{k}" for k in KINDS]
    others = [f"concat(filter(sp_b_{k}, c -> not {_passes(k)}), sp_m_{k}) as more_{k}" for k in KINDS]
    return df.select("doc_id", *keep, *(F.expr(x) for x in kept + others))


def features(kind: str) -> dict[str, str]:
    """Numbers about the format and context of a candidate c, as SQL."""
    digits = "regexp_replace(c.found, '[^0-9]', '')"
    flag = lambda column, pattern: f"int({column} rlike r'{pattern}')"
    return {
        **{f"is_{k}": str(int(k == kind)) for k in KINDS},
        "chars": "char_length(c.found)", "digits": f"length({digits})", "luhn": f"int(luhn_check(if(length({digits}) > 0, {digits}, '1')))",
        "separators": "length(regexp_replace(c.found, '[A-Za-z0-9]', ''))", "brackets": r"length(regexp_replace(c.found, r'[^\[\]()]', ''))",
        "colons": "length(regexp_replace(c.found, '[^:]', ''))", "groups": "size(split(c.found, '[^0-9]+'))",
        "glued_before": flag("c.before", r"[\p{L}\p{N}_./-]$"), "glued_after": flag("c.after", r"[\p{L}\p{N}_/-]"),
        **{n: flag("lower(c.before)", p) for n, p in CONTEXT.items()},
    }


@dataclass(frozen=True)
class Tree:
    """A regression tree of depth at most 2: (feature, threshold, left, right) or a value."""

    root: tuple | float

    def value(self, x: dict) -> float:
        at = self.root
        while isinstance(at, tuple):
            at = at[2] if x[at[0]] < at[1] else at[3]
        return at

    def sql(self) -> str:
        """The value as SQL over a struct x of features."""

        def of(at) -> str:
            return f"if(x.{at[0]} < {at[1]!r}D, {of(at[2])}, {of(at[3])})" if isinstance(at, tuple) else f"{at!r}D"

        return of(self.root)


def _fit_tree(x: np.ndarray, grads: np.ndarray, hess: np.ndarray, depth: int) -> tuple | float:
    """x: a row of features for each candidate."""
    g, h = float(grads.sum()), float(hess.sum())
    leaf = 0.4 * g / (h + 1.0)
    if depth == 0 or len(x) < 8:
        return leaf
    best = (1e-6, None, None)
    for f, name in enumerate(FEATURES):
        order = np.argsort(x[:, f], kind="stable")
        v, a, b = x[order, f], np.cumsum(grads[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = np.where(v[:-1] < v[1:], a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1), 0.0)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), name, float(v[at] + v[at + 1]) / 2)
    if best[1] is None:
        return leaf
    left = x[:, FEATURES.index(best[1])] < best[2]
    low, high = (_fit_tree(x[part], grads[part], hess[part], depth - 1) for part in (left, ~left))
    return (best[1], best[2], low, high)


def boost(rows: list[dict], labels: list[int], rounds: int = 25, depth: int = 2) -> list[Tree]:
    """Gradient boosting with the logistic loss."""
    x, y = np.array([[r[f] for f in FEATURES] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array(labels, np.float64)
    scores, trees = np.zeros(len(rows)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scores))
        tree = Tree(_fit_tree(x, y - p, p * (1 - p), depth))
        scores = scores + np.array([tree.value(r) for r in rows])
        trees.append(tree)
    return trees


def made_up(seed: int, n: int) -> list[tuple[int, str, str, str]]:
    """Sentences with something like personal data in each: its kind, empty if it only looks like that, and its text."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def luhn(k: int, valid: bool) -> str:
        body = "3" + digits(k - 2)
        s = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(ch) for ch in reversed(body)))
        return body + str((-s) % 10 if valid else (1 - s) % 10)

    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    fill = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    out = []
    for k in range(n):
        yes = rng.random() < 0.5
        kind = ("phone", "card", "email", "ip", "card", "phone", "ip", "card")[rng.randrange(8)]
        if kind == "email":
            yes, lead = True, rng.choice(["mail me:", "write to", "contact", ""])
            value = f"{word()}.{word()} {rng.choice(['(at)', '[at]'])} {word()}{rng.choice([' (dot) ', '.', ' [dot] '])}com"
        elif kind == "ip" and yes:
            lead, parts = rng.choice(["ip", "server", "host", "login from", "client", "address", ""]), [str(rng.randint(1, 255)) for _ in range(4)]
            value = rng.choice(["[.]", "(.)", "[dot]", " (dot) "]).join(parts) if rng.random() < 0.5 else ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))
        elif kind == "ip":
            lead = rng.choice(["version", "release", "section", "ip", "ratio", ""])
            value = rng.choice([f"{rng.randint(256, 999)}.{digits(2)}.{digits(1)}.{digits(3)}", ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), ":".join(digits(2) for _ in range(5)), ":".join(digits(1) for _ in range(8))])
        elif kind == "phone" and (yes or rng.random() < 0.5):
            lead = rng.choice(["phone", "call me at", "tel.", "my mobile", "fax", "whatsapp"] if yes else ["order", "serial", "invoice", "ticket", "part"])
            value = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"] if yes else ["{}-{}-{}", "{} {} {}"]).format(digits(3), digits(3), digits(4))
            if rng.random() < 0.4:
                value = rng.choice([f"00{rng.randint(1, 99)} {digits(3)} {digits(4)} {digits(3)}", f"0{rng.randint(1, 9)}{digits(2)}/{digits(4)}{digits(3)}", f"0{rng.randint(1, 9)}{digits(2)} {digits(3)} {digits(4)}"])
        elif kind == "phone":
            lead, value = rng.choice(["score", "sku", ""]), f"+{digits(1)} {digits(2)}-{digits(1)}"
        elif rng.random() < 0.4:
            # digits of something else right before
            lead, value = f"{digits(3)}-{digits(4)}", luhn(16, yes)
        elif yes:
            lead, value = rng.choice(["card", "visa", "paid by credit card", "amex"]), luhn(15, True)
            value = rng.choice(["{}{}{}", "{} {} {}", "{}.{}.{}"]).format(value[:4], value[4:10], value[10:])
        else:
            lead, value = rng.choice(["serial", "order", "build", "ratio", "page", ""]), luhn(rng.choice([3, 4, 6, 8, 9, 12, 15, 16, 22]), False)
        out.append((k, f"{fill()} {lead} {value} {fill()}.", kind if yes else "", value))
    return out


@dataclass(frozen=True)
class PiiModel:
    trees: tuple[Tree, ...]
    thresholds: dict[str, float]

    def likely(self, kind: str, numbered: str) -> str:
        """Of candidates with their features the places of those above their kind's threshold."""
        if math.isinf(self.thresholds[kind]):
            return f"cast(array() as {SPAN})"
        total = " + ".join(t.sql() for t in self.trees)
        return f"transform(filter({numbered}, x -> {total} >= {self.thresholds[kind]!r}D), x -> named_struct('start', x.start, 'end', x.end))"


def _numbered(kind: str, first: str = "'start', c.start, 'end', c.end", as_type: str = "int") -> str:
    """Each candidate's features, after some columns of its own."""
    return f"transform(more_{kind}, c -> named_struct({first}, {', '.join(f"'{n}', cast({v} as {as_type})" for n, v in features(kind).items())}))"


def _apart(added: str, base: str) -> str:
    """The spans of added that overlap none of base (by start, apart from each other)."""
    far = 1 << 60
    free = "s.new = 1 and v.before[i] <= s.start and - v.behind[size(v.all) - 1 - i] >= s.end"
    good = f"transform(filter(v.all, (s, i) -> {free}), s -> named_struct('start', s.start, 'end', s.end))"
    # the greatest end of base spans up to each, and the least start of those from it on
    ends = "transform(w.all, s -> if(s.new = 0, s.end, 0L))"
    starts = f"transform(reverse(w.all), s -> if(s.new = 0, - s.start, {-far}L))"
    scans = _let("v", good, all="w.all", before=_running(ends, _most), behind=_running(starts, _most, -far))
    marked = [f"transform({xs}, s -> named_struct('start', s.start, 'new', {k}, 'end', s.end))" for k, xs in enumerate((base, added))]
    return f"if(size({added}) > 0, {_let('w', scans, all=f'array_sort(concat({", ".join(marked)}))')}, cast(array() as {SPAN}))"


def _labelled(spark: SparkSession, seed: int, n: int) -> tuple[list[dict], list[int], list[str]]:
    found = find_candidates(spark.createDataFrame(made_up(seed, n), "doc_id int, text string, y string, value string"), "doc_id", "text", ("y", "value"))
    rows, labels, kinds = [], [], []
    arrays = [F.expr(_numbered(k, "'found', c.found", "double")) for k in KINDS]
    # a fixed number of made-up sentences
    for r in found.select("y", "value", F.flatten(F.array(*arrays)).alias("c")).orderBy("doc_id").collect():
        for c in r.c:
            rows.append(c.asDict())
            kinds.append(next(k for k in KINDS if c[f"is_{k}"]))
            labels.append(int(r.y == kinds[-1] and r.value == c.found))
    return rows, labels, kinds


_MODELS: dict[tuple[int, int], PiiModel] = {}


def fit(spark: SparkSession, sentences: int = 1200, precision: float = 0.97) -> PiiModel:
    """Boosted trees, and for each kind the least threshold that reaches the precision on sentences not seen."""
    key = (sentences, round(precision * 1000))
    if key not in _MODELS:
        rows, labels, _ = _labelled(spark, 1, sentences)
        trees = boost(rows, labels)
        rows, labels, kinds = _labelled(spark, 2, sentences)
        scored = [(sum(t.value(x) for t in trees), y, k) for x, y, k in zip(rows, labels, kinds, strict=True)]
        thresholds = {}
        for kind in KINDS:
            mine = sorted(((s, y) for s, y, k in scored if k == kind), reverse=True)
            right, best = 0, math.inf
            for n, (s, y) in enumerate(mine, 1):
                right += y
                if right / n >= precision and (n == len(mine) or mine[n][0] < s):
                    # halfway to what comes next, even odds if nothing does
                    best = max(0.0, (s + mine[n][0]) / 2) if n < len(mine) else 0.0
            thresholds[kind] = best
        _MODELS[key] = PiiModel(tuple(trees), thresholds)
    return _MODELS[key]


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: base_KIND and all_KIND, arrays of (start, end), by start; columns in keep go along."""
    df = find_candidates(docs, id_col, text_col, keep)
    place = "c -> named_struct('start', c.start, 'end', c.end)"
    df = df.withColumns({f"base_{k}": F.expr(f"transform(base_{k}, {place})") for k in KINDS} | {f"add_{k}": F.expr(_numbered(k)) for k in KINDS})
    df = df.withColumns({f"add_{k}": F.expr(model.likely(k, f"add_{k}")) for k in KINDS})
    df = df.withColumns({f"add_{k}": F.expr(_apart(f"add_{k}", f"base_{k}")) for k in KINDS})
    # base spans come in order; what is added to them lies apart
    once = lambda xs: _let("v", "filter(v.xs, (s, i) -> i = 0 or s <> v.xs[i - 1])", xs=f"array_sort({xs})")
    every = [F.expr(f"if(size(add_{k}) > 0, {once(f'concat(base_{k}, add_{k})')}, base_{k}) as all_{k}") for k in KINDS]
    return df.select(F.col("doc_id").alias(id_col), *keep, *(f"base_{k}" for k in KINDS), *every)


def listed(prefix: str) -> Column:
    """The spans of all kinds as kind:start:end, by kind as listed, then start, joined by commas."""
    parts = [f"transform({prefix}_{k}, s -> concat_ws(':', '{k}', s.start, s.end))" for k in KINDS]
    return F.expr(f"array_join(concat({', '.join(parts)}), ',')")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))


def redact(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; where spans overlap, one mark names the first."""
    names = tuple(c for c in docs.columns if c not in (id_col, text_col))
    renamed = docs.select(F.col(id_col), F.col(text_col), *(F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(names)), F.col(text_col).alias("_text"))
    keep = (*(f"_keep{i}" for i in range(len(names))), "_text")
    found = find(renamed, model, id_col, text_col, keep)
    marks = [f"transform(all_{k}, s -> named_struct('start', s.start, 'end', s.end, 'kind', '{k}'))" for k in KINDS]
    found = found.withColumn("_marks", F.expr(f"concat({', '.join(marks)})"))

    def cut(start: str, end: str) -> str:
        """The text from start to end, from the pieces that it lies in."""
        first, last, at, size = f"int(({start}) div {CUT_CHARS})", f"int(({end} - 1) div {CUT_CHARS})", f"int(({start}) % {CUT_CHARS} + 1)", f"int(({end} - 1) % {CUT_CHARS} + 1)"
        several = f"concat(substr(v.text[{first}], {at}), array_join(slice(v.text, {first} + 2, {last} - {first} - 1), ''), substr(v.text[{last}], 1, {size}))"
        return f"case when {end} <= {start} then '' when {first} = {last} then substr(v.text[{first}], {at}, int({end} - {start})) else {several} end"

    # a span that starts inside those before it makes no mark of its own
    done = "if(i > 0, v.ends[greatest(i - 1, 0)], 0L)"
    parts = f"transform(v.marks, (s, i) -> {_let('e', f'if(s.start >= e.done, concat({cut("e.done", "s.start")}, "<", s.kind, ">"), "")', done=done)})"
    joined = f"concat(array_join({parts}, ''), {_let('e', cut('e.done', 'v.size'), done='v.ends[size(v.marks) - 1]')})"
    whole = f"regexp_extract_all(_text, r'(?s).{{1,{CUT_CHARS}}}', 0)"
    ended = _let("v", joined, marks="w.marks", ends=_running("transform(w.marks, s -> s.end)", _most), text=whole, size="bigint(char_length(_text))")
    text = F.expr(f"if(size(_marks) > 0, {_let('w', ended, marks='array_sort(_marks)')}, _text)")
    done = found.select(id_col, text.alias(text_col), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(names)))
    return done.select(*(f"`{c}`" for c in docs.columns))
