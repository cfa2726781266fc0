"""Personal data: base rules, and spans that boosted trees select among the candidates of high-recall generators.

Generators propose spans per kind, which may overlap. Every candidate has a few small format and context features. Weak labels
come from strict rules (a candidate that is a valid e-mail address, address of a machine, card or phone number by the
base rules, or a quoted credential); the features leave out what the rules check (check digits, octet sizes), so that a candidate which looks and
stands like the valid ones scores high without being valid. Trees are boosted on the counts of feature combinations in
all documents of one fold, thresholds are calibrated per kind on those of the other. All work on texts is in SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sigframe.llm.common import bound_once, whole

KINDS = ("email", "ip", "card", "phone", "secret")
# The base rules. Loops are possessive where nothing can follow, which keeps the matches and the stack small.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators.
CANDIDATES = {
    "email": rf"(?<!{LOCAL}){LOCAL}++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,5}+(?:\.[0-9]{1,5}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+(])[+(]{0,2}[0-9](?:[ ().-]{0,3}[0-9]){6,14}+(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ .-]{1,2}[0-9]", "phone": r"[0-9]{2}|[0-9][ ().-]{1,3}[0-9]", "secret": "[0-9]"}
#: The same for the base rules: what every match has in it.
BASE_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: What a text must contain to be searched at all.
SOME = r"[0-9@]|[(\[]at[)\]]"
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
CUES = {"email": "mail|contact", "ip": r"\bip\b|addr|host|server", "card": "card|visa|pay|credit", "phone": "tel|phone|call|fax|mobile", "secret": "token|key|secret|passw"}
FEATURES = ("kind", "digits", "groups", "size", "lead", "before", "after", "cue")
SPAN = "array<struct<start:int,kind:int,end:int>>"
_CHUNK = 512


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Every match of a text, left to right: start and end in code points, the match, what stands before it and after it.

    The gaps between matches give the places. They are summed up in chunks, because a growing list is copied at each step.
    """
    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = bound_once(gaps, lambda g: F.transform(found, lambda m, i: F.struct(
            F.length(F.get(g, i)).alias("skip"), F.length(m).alias("size"), m.alias("m"), F.right(F.get(g, i), F.lit(24)).alias("before"),
            F.left(F.get(g, i + 1), F.lit(1)).alias("after"))))

        def one(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["skip"]
            item = F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after"))
            return F.struct((start + s["size"]).alias("at"), F.array_append(acc["out"], item).alias("out"))

        def chunk(acc: Column, s: Column, c: Column) -> Column:
            empty = F.lit([]).cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
            part = F.aggregate(F.slice(s, c * _CHUNK + 1, F.lit(_CHUNK)), F.struct(acc["at"].alias("at"), empty.alias("out")), one)
            return bound_once(part, lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["out"], p["out"]).alias("out")))

        first = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<array<struct<start:int,end:int,m:string,before:string,after:string>>>").alias("out"))
        return bound_once(steps, lambda s: F.flatten(F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _CHUNK).cast("int")), first, lambda acc, c: chunk(acc, s, c))["out"]))

    none = F.lit([]).cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    tried = F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), 0))
    return bound_once(tried, lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) > 0, placed(found)).otherwise(none))


def passes(kind: str, m: Column) -> Column:
    """What a match of the base pattern has to pass."""
    n = F.length(digits(m))
    return {"email": F.lit(True), "ip": m.rlike(OCTETS), "card": n.between(12, 19) & F.call_function("luhn_check", digits(m)), "phone": n.between(9, 15)}[kind]


def base_spans(text: Column) -> Column:
    def of(nth: int, kind: str) -> Column:
        found = F.filter(matches(text, BASE[kind], BASE_NEEDS[kind]), lambda x: passes(kind, x["m"]))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(nth).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(BASE)))).cast(SPAN)


def strict(kind: str, x: Column) -> Column:
    """The weak label of a candidate."""
    if kind == "secret":
        return x["before"].rlike(r"(?i)(?:token|key|secret|password)\s*[=:]\s*[\"']?$") & (F.length(x["m"]) >= 32)
    return x["m"].rlike(f"^(?:{BASE[kind]})$") & passes(kind, x["m"])


def sort_of(char: Column) -> Column:
    """Class of a neighbouring character: none, letter, digit, white space, or a mark."""
    return (F.when(char == "", 0).when(char.rlike(r"\p{L}"), 1).when(char.rlike("[0-9]"), 2).when(char.rlike(r"\s"), 3).otherwise(4))


def candidates(text: Column) -> Column:
    """All candidates with their features (small integers) and weak label."""
    def seen(kind: str) -> Column:
        nth = KINDS.index(kind)
        found = matches(text, CANDIDATES[kind], NEEDS[kind])
        if kind == "secret":
            found = F.filter(found, lambda x: x["m"].rlike("[0-9]"))
        return F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(nth).alias("kind"), F.least(F.length(digits(x["m"])), F.lit(20)).alias("digits"),
            F.least(F.size(F.split(x["m"], "[^A-Za-z0-9]+")), F.lit(7)).alias("groups"), F.least(F.floor(F.length(x["m"]) / 4).cast("int"), F.lit(12)).alias("size"),
            F.when(x["m"].startswith("+"), 1).when(x["m"].startswith("("), 2).when(x["m"].rlike("^[0-9]"), 3).otherwise(0).alias("lead"),
            sort_of(F.right(x["before"], F.lit(1))).alias("before"), sort_of(x["after"]).alias("after"),
            x["before"].rlike(f"(?i){CUES[kind]}").cast("int").alias("cue"), strict(kind, x).alias("label")))

    return F.concat(*(seen(k) for k in KINDS))


@dataclass
class Trees:
    """Boosted trees over FEATURES: (feature, limit, below, above) or a value; and the threshold of each kind."""

    trees: list = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, x: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, limit, below, above = node
            return F.when(x[FEATURES[f]] <= limit, value(below)).otherwise(value(above))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + value(t)
        return out

    def margins(self, rows: np.ndarray) -> np.ndarray:
        def value(node, x) -> np.ndarray:
            if not isinstance(node, tuple):
                return np.full(len(x), float(node))
            f, limit, below, above = node
            return np.where(x[:, f] <= limit, value(below, x), value(above, x))

        return self.start + sum((value(t, rows) for t in self.trees), np.zeros(len(rows)))

    def selects(self, x: Column) -> Column:
        if not self.thresholds:
            return F.lit(False)
        least = F.lit(float("inf"))
        for kind, t in self.thresholds.items():
            least = F.when(x["kind"] == kind, F.lit(t)).otherwise(least)
        return self.margin(x) >= least


def boost(rows: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.4) -> Trees:
    """Gradient boosting of the logistic loss on distinct feature rows with counts of either label."""
    model = Trees()
    if not good.sum() or not bad.sum():
        return model
    model.start = float(np.log(good.sum() / bad.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.margins(rows)))
        g, h = good - (good + bad) * p, (good + bad) * p * (1 - p)

        def grow(at: np.ndarray, left: int):
            total_g, total_h = g[at].sum(), h[at].sum()
            found = None
            for f in range(rows.shape[1] if left else 0):
                order = at[np.argsort(rows[at, f], kind="stable")]
                cg, ch, v = np.cumsum(g[order]), np.cumsum(h[order]), rows[order, f]
                cuts = np.flatnonzero(v[1:] != v[:-1])
                if len(cuts):
                    gain = cg[cuts] ** 2 / (ch[cuts] + 1) + (total_g - cg[cuts]) ** 2 / (total_h - ch[cuts] + 1)
                    best = int(np.argmax(gain))
                    if found is None or gain[best] > found[0] + 1e-9:
                        found = (gain[best], f, int(v[cuts[best]]))
            if found is None or found[0] <= total_g**2 / (total_h + 1) + 1e-6:
                return round(float(rate * total_g / (total_h + 1)), 6)
            below = rows[at, found[1]] <= found[2]
            return found[1], found[2], grow(at[below], left - 1), grow(at[~below], left - 1)

        model.trees.append(grow(np.arange(len(rows)), depth))
    return model


def calibrate(model: Trees, rows: np.ndarray, good: np.ndarray, bad: np.ndarray, precision: float) -> None:
    """The least margin per kind above which the share of good candidates is at least ``precision``."""
    margins = model.margins(rows)
    for kind in np.unique(rows[:, 0]).tolist() if len(rows) else []:
        at = np.flatnonzero(rows[:, 0] == kind)
        levels = np.unique(margins[at])[::-1]
        for m in levels:
            above = at[margins[at] >= m]
            if good[above].sum() >= precision * (good[above].sum() + bad[above].sum()):
                model.thresholds[kind] = float(m) - 1e-9


def train(docs: DataFrame, text: str = "text", precision: float = 0.98) -> Trees:
    """Trees from the candidates of all documents. What reaches the driver is one count per combination of features, whose
    number is bounded by their ranges."""
    rows = docs.select(whole(text).alias("_t"))
    rows = rows.where(F.col("_t").rlike(SOME)).select(
        F.explode(candidates(F.col("_t"))).alias("c"), F.pmod(F.xxhash64("_t"), F.lit(2)).alias("fold"))
    counts = rows.groupBy("fold", *(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(
        F.count_if("c.label").alias("good"), F.count_if(~F.col("c.label")).alias("bad")).collect()
    counts.sort()
    table = np.array([tuple(r) for r in counts], np.int64).reshape(-1, len(FEATURES) + 3)
    learn, check = table[table[:, 0] == 0], table[table[:, 0] == 1]
    model = boost(learn[:, 1:-2], learn[:, -2].astype(float), learn[:, -1].astype(float))
    calibrate(model, check[:, 1:-2], check[:, -2].astype(float), check[:, -1].astype(float), precision)
    return model


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of(text: Column, model: Trees) -> Column:
    """Struct of ``base`` and ``spans`` (all spans) of a text, each by start, kind and end."""
    added = F.transform(F.filter(candidates(text), model.selects),
                        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))).cast(SPAN)
    return bound_once(base_spans(text), lambda b: F.struct(b.alias("base"), F.array_sort(F.array_distinct(F.concat(b, added))).alias("spans")))


def find(docs: DataFrame, model: Trees, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep``, ``base`` and ``spans`` of every whole text: arrays of (start, kind, end) in code points, end exclusive.

    NULL and empty texts have none. Repeated rows are read each. A text without digit, @ or (at) is not searched.
    """
    rows = docs.select(*keep, whole(text).alias("_text"))
    none = F.lit([]).cast(SPAN)
    rows = rows.withColumn("_found", F.when(F.col("_text").rlike(SOME), spans_of(F.col("_text"), model)))
    return rows.select("*", F.coalesce("_found.base", none).alias("base"), F.coalesce("_found.spans", none).alias("spans")).drop("_found")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(F.get(F.array(*(F.lit(k) for k in KINDS)), s["kind"])), F.lit("]"))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, tag))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("out"))
    done = bound_once(F.aggregate(spans, start, step), lambda a: F.array_join(F.array_append(a["out"], F.substring(text, a["at"] + 1, F.length(text))), ""))
    return F.when(F.size(spans) > 0, done).otherwise(text)
