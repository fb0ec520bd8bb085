"""Personal data: bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: the four base kinds, leftmost and non-overlapping, validated (address parts, Luhn, digits).
2. Each seed induces lexical patterns: the word before it, the word after it, and both.
3. Looser forms of the kinds (spelt-out at signs, defanged addresses, numbers without a prefix or with
   another grouping) give candidate instances, with the same three patterns each.
4. Patterns and instances form a weighted graph. Over ``ROUNDS`` rounds a pattern's score is the mean
   score of its occurrences' instances (seeds 1, candidates what their patterns gave them). What a pattern takes
   from a candidate is the score of the candidate's best unrelated pattern (neither that pattern, nor a part of it,
   nor one that has it as a part), or the pattern's own share of seeds: its own vote counts once and does not
   grow over the rounds.
5. Patterns with at least ``SUPPORT`` different seeds in as many documents (counted exactly) vote, and with a
   score of ``CONFIDENCE`` or more they discover the candidates beside them.

Base spans stay whatever the graph says. Positions are code points. Patterns of unbounded repetition
are possessive, so a text's length costs neither stack nor backtracking.

Defined cases: null texts are empty and have no spans; equal rows get equal rows; a document without
digits and at signs is not searched; overlapping additions: the leftmost, then longest one is added, none over a base span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, stash

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ROUNDS = 8, 0.95, 3
#: Additions to at most so many documents are sent to all executors; more are joined by shuffle.
SEND_ROWS = 200_000
AROUND = 40                                    # code points of context on either side

#: The base forms; starts that a run's own start would have taken are ruled out, so each run is read once.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,64}+){1,8}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20-][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{16}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return total + F.when(twice, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(16, 19), _luhn(v)).otherwise(F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _valid(kind: str):
    return lambda x: _VALID[kind](x["v"])


def _is(kind: int):
    return lambda x: x["kind"] == kind


_SPAN = "array<struct<kind:int,s:int,e:int,v:string>>"


def _matches(text: Column, pattern: str, kind: int, guard: Column) -> Column:
    """All matches with positions: what stands between them adds up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        s = acc["pos"] + F.length(m["gap"])
        e = s + F.length(m["v"])
        one = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), m["v"].alias("v"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    return F.when(guard, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with __id, __base and __loose (candidates off the base spans), each with the text around."""
    t = F.col("__t")
    digit, at = F.col("__digit"), F.instr(t, "@") > 0
    guards = {"email": at, "ip": digit, "card": digit, "phone": digit & (F.instr(t, "+") > 0)}
    spelt = t.rlike(r"@|[(\[]at[)\]]")
    base = F.concat(*[F.filter(_matches(t, _BASE[k], i, guards[k]), _valid(k)) for i, k in enumerate(KINDS)])
    loose = F.concat(*[_matches(t, _LOOSE[k], i, spelt if k == "email" else digit) for i, k in enumerate(KINDS)])
    df = docs.withColumn("__t", F.coalesce("text", F.lit(""))).withColumn("__digit", t.rlike("[0-9]")) \
        .withColumn("__base", base)
    free = F.filter(loose, lambda x: ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    df = df.withColumn("__loose", F.when(digit | spelt, free).otherwise(F.array().cast(_SPAN)))

    def context(x: Column) -> Column:
        lead = F.least(x["s"], F.lit(AROUND))
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"),
                        F.lower(F.substring(t, x["s"] - lead + 1, lead)).alias("left"), F.lower(F.substring(t, x["e"] + 1, F.lit(AROUND))).alias("right"))
    return df.withColumns({"__base": F.transform("__base", context), "__loose": F.transform("__loose", context),
                           "__id": F.monotonically_increasing_id()}).drop("__t", "__digit")


def _edges(spans: DataFrame, column: str, seed: int) -> DataFrame:
    """(kind, pattern, v, seed, n, id): occurrences of pattern and instance, pre-aggregated."""
    x = spans.select("__id", F.explode(column).alias("x"))
    left = F.regexp_extract("x.left", r"(\S+)\s*$", 1)
    right = F.regexp_extract("x.right", r"^\S{0,3}?\s+(\S+)(?=\s)", 1)
    pattern = F.explode(F.array_distinct(F.filter(F.array(
        F.when(left != "", F.concat(F.lit("l "), left)), F.when(right != "", F.concat(F.lit("r "), right)),
        F.when((left != "") & (right != ""), F.concat(F.lit("b "), left, F.lit(" "), right))), lambda p: p.isNotNull())))
    return x.select("__id", F.col("x.kind").alias("kind"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.v").alias("v"), pattern.alias("pattern"),
                    F.lit(seed).alias("seed"))


def _votes(graph: DataFrame, patterns: DataFrame, alone: DataFrame) -> DataFrame:
    """``graph`` with the score of each instance as its pattern may count it: seeds 1, candidates by their unrelated
    patterns and by the pattern's score from seeds ``alone``."""
    of = F.substring("pattern", 1, 1)
    words = F.split("pattern", " ")
    left = F.when(of != "r", F.get(words, F.lit(1)))
    right = F.when(of == "r", F.get(words, F.lit(1))).when(of == "b", F.get(words, F.lit(2)))
    # of the patterns of a class, the best and the best with another key: what remains if one key is left out
    classes = {"l": (of == "l", left), "r": (of == "r", right), "b": (of == "b", F.col("pattern")), "lb": (of != "r", left), "rb": (of != "l", right)}
    seen = graph.where("seed = 0").select("kind", "pattern", "v").join(patterns.select("kind", "pattern", "score"), ["kind", "pattern"])
    best = seen.groupBy("kind", "v").agg(*[F.max(F.when(one, F.struct("score", key.alias("key")))).alias(c) for c, (one, key) in classes.items()])
    best = stash(best, "best-patterns")
    next_best = seen.join(best, ["kind", "v"]).groupBy("kind", "v").agg(
        *[F.max(F.when(one & (key != F.col(f"{c}.key")), F.col("score"))).alias(f"{c}2") for c, (one, key) in classes.items()])

    def without(c: str) -> Column:
        return F.when(F.col(f"{c}.key") != classes[c][1], F.col(f"{c}.score")).otherwise(F.col(f"{c}2"))
    vote = F.when(of == "l", F.greatest(without("lb"), F.col("r.score"))).when(of == "r", F.greatest(without("rb"), F.col("l.score"))) \
        .otherwise(F.greatest(without("l"), without("r"), without("b")))
    both = best.join(next_best, ["kind", "v"])
    own = alone.select("kind", "pattern", F.col("score").alias("own"))
    return graph.join(both, ["kind", "v"], "left").join(own, ["kind", "pattern"], "left").select("kind", "pattern", "v", "seed", "n",
        F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce(F.greatest(vote, "own"), F.lit(0.0))).alias("score"))


def _discoveries(spans: DataFrame) -> DataFrame:
    """__id, kind, s, e of candidates beside a pattern of high confidence."""
    occ = stash(_edges(spans, "__base", 1).union(_edges(spans, "__loose", 0)), "occurrences")
    # a pattern that no seed of the kind has, or that has no candidate beside it, plays no part
    both = occ.groupBy("kind", "pattern").agg(F.sum("seed").alias("ones"), F.sum(1 - F.col("seed")).alias("others")).where("ones > 0 and others > 0")
    graph = stash(occ.join(both.select("kind", "pattern"), ["kind", "pattern"]).groupBy("kind", "pattern", "v", "seed").agg(F.count("*").alias("n")), "graph")
    docs = occ.where("seed = 1").select("kind", "pattern", "__id").distinct().groupBy("kind", "pattern").agg(F.count("*").alias("docs"))
    docs = stash(docs.join(both.select("kind", "pattern"), ["kind", "pattern"]), "seed-docs")
    # the pattern's occurrences with seeds of other kinds count against it
    against = occ.where("seed = 1").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    foreign = against.withColumn("all", F.sum("n").over(Window.partitionBy("pattern"))).select("pattern", "kind", (F.col("all") - F.col("n")).alias("foreign"))
    foreign = stash(foreign.join(both.select("kind", "pattern"), ["kind", "pattern"]), "foreign")
    alone = None
    voted = graph.withColumn("score", F.col("seed").cast("double"))
    for k in range(ROUNDS):
        patterns = stash(voted.groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("score")).alias("good"), F.sum("n").alias("n"), F.sum("seed").alias("seeds"))
                         .join(docs, ["kind", "pattern"]).join(foreign, ["kind", "pattern"], "left")
                         .select("kind", "pattern", "seeds", "docs", (F.col("good") / (F.col("n") + F.coalesce("foreign", F.lit(0)))).alias("score")), "patterns")
        supported = patterns.where((F.col("seeds") >= SUPPORT) & (F.col("docs") >= SUPPORT))
        alone = supported if k == 0 else alone
        if k < ROUNDS - 1:
            voted = stash(_votes(graph, supported, alone), "votes")
    sure = supported.where(F.col("score") >= CONFIDENCE)
    return occ.where("seed = 0").join(sure.select("kind", "pattern"), ["kind", "pattern"]).select("__id", "kind", "s", "e").distinct()


def find(docs: DataFrame) -> DataFrame:
    """``docs`` and __base, __added: arrays of (kind, s, e) by kind, then start. Other columns stay as they are."""
    return _searched(_with_spans(docs))


def _searched(spans: DataFrame) -> DataFrame:
    spans = stash(spans, "spans")
    plain = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    added = _discoveries(spans).groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("e")).alias("minus"), "kind"))).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(x["kind"].alias("kind"), x["s"].alias("s"), (-x["minus"]).alias("e"))
        ok = x["s"] >= acc["end"]
        return F.struct(F.when(ok, -x["minus"]).otherwise(acc["end"]).alias("end"),
                        F.when(ok, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))
    empty = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    chosen = F.array_sort(F.aggregate("all", F.struct(F.lit(0).alias("end"), empty.alias("out")), step, lambda acc: acc["out"]))
    added = stash(added.select("__id", chosen.alias("__added")), "added")
    if added.count() <= SEND_ROWS:
        added = F.broadcast(added)
    return spans.join(added, "__id", "left").withColumns({"__base": plain("__base"), "__added": F.coalesce("__added", empty)}) \
        .drop("__id", "__loose")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added): one row per input row."""
    found = _searched(_with_spans(docs.select("doc_id", "text")).drop("text"))
    name = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["s"], x["e"])), ",")
    number = [F.size(F.filter("__base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *number, F.sha2(shown("__base"), 256).alias("base_sha256"),
                        shown(F.array_sort(F.concat("__base", "__added"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``[KIND]``; of overlapping spans the leftmost counts."""
    packed, restore = aside(docs)
    found = find(packed)
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(F.concat("__base", "__added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        ok = x["s"] >= acc["end"]
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["end"] + 1, x["s"] - acc["end"]), F.element_at(label, x["kind"] + 1))
        return F.struct(F.when(ok, x["e"]).otherwise(acc["end"]).alias("end"), F.when(ok, more).otherwise(acc["out"]).alias("out"))
    done = F.aggregate(order, F.struct(F.lit(0).alias("end"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["end"] + 1, F.length("text"))))
    text = F.when((F.size("__base") > 0) | (F.size("__added") > 0), done).otherwise(F.col("text"))
    return restore(found, text=text)
