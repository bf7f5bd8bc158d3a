"""Training sets: generate, add the originals, rebalance.  Any number of scenarios at once.

All scenarios share one table of row variants (the originals and everything any generator
made of them).  A scenario is a vector component: how many copies of the variant its training
set holds.  So texts are generated, hashed and tokenised once, not once per scenario.

A cell is the rows of one generator, sample flag and label.  Within a cell the vector changes only
at limits, where some set is cut or topped up, so a small table of limits and vectors per cell
(``set_plan``) says everything about any number of scenarios.  To find the limits, the keys of the
variants are written once, without texts, and counted by cell and ever longer prefixes.  The
texts are made again in the pass that uses them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.text import label_of, order_key
from counterpoise.operators.changes import methods_of
from counterpoise.operators.generate import Gen, Lexicons, generate
from counterpoise.operators.sampling import copies, in_minority_sample, locate, number_equal
from counterpoise.plans.specs import Spec
from counterpoise.session import spool

ORIGINAL = -1
CELL = ["gen", "in_sample", "label"]
# Second key of a variant: its content.
TIE = "md5(concat_ws('\u0001', cast(label as string), text))"
NOTHING, EVERYTHING = "", "~"  # below and above all keys
JUST_BELOW = "}"
NTH_DIGITS = 16


def distinct_gens(specs: Sequence[Spec]) -> list[Gen]:
    out: list[Gen] = []
    for s in specs:
        if s.gen is not None and _both(s.gen) not in out:
            out.append(_both(s.gen))
    return out


def _both(g: Gen) -> Gen:
    """Generator without its class scope; similar words and blankout then serve both scopes."""
    return g if g.kind == "antonym" else replace(g, minority=False)


def sampled(in_sample: Column | None) -> Column:
    return F.coalesce(in_minority_sample() if in_sample is None else in_sample, F.lit(False))


def row_variants(
    corpus: DataFrame,
    gens: Sequence[Gen],
    lex: Lexicons = Lexicons(),
    in_sample: Column | None = None,
    seed: str = "blank",
    texts: bool = True,
) -> DataFrame:
    """(src_id, in_sample, gen, method, label, text, key): originals (gen -1), generated rows.

    ``key`` is the random order in which rows are taken when a set is cut or topped up; ``drawn``
    comes along if a generator asks for further draws.  Without ``texts`` the same rows have neither.
    """
    rows = corpus.select("id", "sentiment", "text", sampled(in_sample).alias("in_sample"))
    drawn = ["drawn"] if texts and any(g.draws for g in gens) else []
    text = ["text"] if texts else []
    originals = rows.select(
        F.col("id").alias("src_id"),
        "in_sample",
        F.lit(ORIGINAL).alias("gen"),
        F.lit("original").alias("method"),
        label_of("sentiment").alias("label"),
        *text,
        *[F.array().cast("array<string>").alias(c) for c in drawn],
    )
    variants = originals
    if gens:
        label = label_of("sentiment").alias("label")
        made = generate(rows, gens, lex, seed, texts=texts).select(
            "src_id", "in_sample", "gen", "method", label, *text, *drawn
        )
        variants = originals.unionByName(made)
    return variants.withColumn("key", order_key("order", "src_id", "method"))


@dataclass(frozen=True)
class Cell:
    """Rows that all conditions of a scenario treat alike; ``part`` counts the fraction limits
    below their keys."""

    gen: int
    in_sample: bool
    label: int
    part: int = 0


def _is_original(s: Spec, c: Cell) -> bool:
    return c.gen == ORIGINAL and (s.base == "full" or c.in_sample)


def _is_made(s: Spec, gens: Sequence[Gen], c: Cell) -> bool:
    """A generated row of the scenario before any sampling."""
    if s.gen is None or c.gen != gens.index(_both(s.gen)):
        return False
    return (s.base == "full" or c.in_sample) and (c.label == 1 or not s.gen.minority)


class SetPlan:
    """How often the rows of every cell occur in each scenario, by the limits of their keys.

    A row's place is its key; where a limit falls among rows that share a key, it goes on with
    their second key and with the number of equal rows.  ``variants_of`` gives the variants with some
    keys; they are read for the keys that limits fall on only.
    """

    def __init__(
        self,
        specs: Sequence[Spec],
        gens: Sequence[Gen],
        variants_of: Callable[[list[str]], DataFrame],
        keys: DataFrame | None = None,
    ):
        self.specs, self.gens = specs, gens
        self.tied: set[str] = set()
        self.equal: set[tuple[str, str]] = set()
        self.fractions: dict[int, str] = {}  # scenario -> limit
        self.parts: list[str] = []  # the different ones, ascending
        self.limits: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        self.variants_of = variants_of
        if keys is None:
            return
        some = {
            f"m{i}": (lambda c, s=s: _is_made(s, gens, c), lambda n, s=s, i=i: int(n[f"m{i}"] * s.fraction))
            for i, s in enumerate(specs) if s.gen and s.fraction < 1
        }
        if some:
            self._find(keys, some)
            self.fractions = {i: self.limits[f"m{i}"] for i in range(len(specs)) if f"m{i}" in some}
            self.parts = sorted(set(self.fractions.values()))
            if self.tied:
                placed = self._tied_rows().select(*CELL, "key", "place")
                others = keys.filter(~F.col("key").isin(sorted(self.tied)))
                keys = others.withColumn("place", F.col("key")).unionByName(spool(placed, "tied"))
        groups: dict = {}
        for i, s in enumerate(specs):
            groups |= self._groups(i, s)
        if groups:
            self._find(keys, groups)

    def _inside(self, i: int, c: Cell) -> tuple[bool, bool]:
        """(is an original, is a generated row) of scenario i, after its fraction is taken."""
        s = self.specs[i]
        made = _is_made(s, self.gens, c)
        if i in self.fractions:
            made = made and c.part <= self.parts.index(self.fractions[i])
        return _is_original(s, c), made

    def _groups(self, i: int, s: Spec) -> dict:
        """Groups with their condition on a cell and the number of rows to take, or None."""

        def of(label: int, *which: int):
            return lambda c: c.label == label and any(self._inside(i, c)[w] for w in which)

        a, b = f"a{i}", f"b{i}"
        if s.perturb:
            return {
                f"o{i}": (of(0, 0), lambda n: n[f"o{i}"] // 2),
                f"g{i}": (of(0, 1), lambda n: n[f"o{i}"] // 2),
            }
        if s.rebalance == "under":
            return {a: (of(0, 0, 1), lambda n: n[b]), b: (of(1, 0, 1), None)}
        if s.rebalance == "over":
            return {a: (of(0, 0, 1), None), b: (of(1, 0, 1), lambda n: n[a] % n[b] if n[b] else 0)}
        return {}

    def _find(self, keys: DataFrame, groups: dict[str, tuple[Callable, Callable | None]]) -> None:
        rows, by = keys, [*CELL]
        if self.fractions:
            place = F.col("place") if "place" in keys.columns else F.col("key")
            below = F.filter(F.array(*[F.lit(p) for p in self.parts]), lambda e: e < place)
            rows, by = keys.withColumn("part", F.size(below)), [*CELL, "part"]
        cell = lambda r: Cell(r["gen"], r["in_sample"], r["label"], r["part"] if "part" in by else 0)
        inside = {g: (lambda r, f=f: f(cell(r))) for g, (f, _) in groups.items()}
        wanted = {g: n for g, (_, n) in groups.items() if n is not None}
        counts, found = locate(rows, by, "key", inside, wanted)
        self.counts |= counts
        tied = {g: (k, rank) for g, (k, rank, n) in found.items() if rank < n}
        self.limits |= {g: k + EVERYTHING if k not in (NOTHING, EVERYTHING) else k for g, (k, _, _) in found.items()}
        if not tied:
            return
        # the same among the rows that share a key; their texts are read, and not written
        self.tied |= {k for k, _ in tied.values()}
        again = self._tied_rows()
        if self.fractions:
            below = F.filter(F.array(*[F.lit(p) for p in self.parts]), lambda e: e < F.col("place"))
            again = again.withColumn("part", F.size(below))
        again = spool(again.select(*by, "key", F.expr(TIE).alias("tie")), "tied")
        same = {g: (lambda r, g=g, k=k: r["key"] == k and inside[g](r)) for g, (k, _) in tied.items()}
        ranks = {g: (lambda n, rank=rank: rank) for g, (_, rank) in tied.items()}
        # a tied group that is wanted whole below its key never comes here, so ranks are within it
        _, second = locate(again, [*by, "key"], "tie", same, ranks)
        for g, (tie, rank, n) in second.items():
            key = tied[g][0]
            if rank < n:
                self.equal.add((key, tie))
                self.limits[g] = f"{key}{tie}{rank:0{NTH_DIGITS}d}{EVERYTHING}"
            else:
                self.limits[g] = f"{key}{tie}{EVERYTHING}"

    def _tied_rows(self) -> DataFrame:
        return self.placed(self.variants_of(sorted(self.tied)))

    def most_copies(self, gen: Gen) -> int:
        """No row of a generator has more copies in any set."""
        most = 1
        for i, s in enumerate(self.specs):
            if s.gen is not None and _both(s.gen) == gen and s.rebalance == "over":
                major, minor = self.counts[f"a{i}"], self.counts[f"b{i}"]
                most = max(most, min(s.cap, major // minor + 1) if minor else 1)
        return most

    def copies_of(self, c: Cell, place: str) -> list[int]:
        """Copies of a row of a cell at a place, per scenario."""
        out = []
        for i, s in enumerate(self.specs):
            original, made = self._inside(i, c)
            n = int(original or made)
            if n and s.perturb and c.label == 0:
                n = int(place < self.limits[f"o{i}" if original else f"g{i}"])
            elif n and s.rebalance == "under" and c.label == 0:
                n = int(place < self.limits[f"a{i}"])
            elif n and s.rebalance == "over" and c.label == 1:
                major, minor = self.counts[f"a{i}"], self.counts[f"b{i}"]
                n = min(s.cap, major // minor + int(place < self.limits[f"b{i}"]))
            out.append(n)
        return out

    def placed(self, variants: DataFrame) -> DataFrame:
        """Adds ``place``: the key, continued where limits fall among rows of one key."""
        if not self.tied:
            return variants.withColumn("place", F.col("key"))
        equal = [f"(key = '{k}' AND {TIE} = '{t}')" for k, t in sorted(self.equal)]
        rows = number_equal(variants, " OR ".join(equal) or None, "nth")
        nth = F.lpad(F.col("nth").cast("string"), NTH_DIGITS, "0")
        full = F.concat("key", F.expr(TIE), nth)
        place = F.when(F.col("key").isin(sorted(self.tied)), full).otherwise(F.col("key"))
        return rows.withColumn("place", place).drop("nth")

    def cells(self, tested: Callable | None = None) -> list[tuple]:
        """(gen, in_sample, label, cuts, ws, tws): the vectors of every cell between its limits."""
        edges = sorted({e for e in self.limits.values() if e not in (NOTHING, EVERYTHING)})
        edges = sorted({*edges, *(e for e in self.fractions.values() if e not in (NOTHING, EVERYTHING))})
        rows = []
        for gen in range(ORIGINAL, len(self.gens)):
            for in_sample in (False, True):
                for label in (0, 1):
                    cuts, ws = [], []
                    for place in [*edges, EVERYTHING]:
                        at = place[:-1] + JUST_BELOW  # above all limits before this one
                        part = sum(p < at for p in self.parts)
                        w = self.copies_of(Cell(gen, in_sample, label, part), at)
                        if ws and ws[-1] == w:
                            cuts[-1] = place
                        else:
                            cuts.append(place)
                            ws.append(w)
                    cell = Cell(gen, in_sample, label)
                    tws = [tested(cell, w) if tested else [] for w in ws]
                    rows.append((gen, in_sample, label, cuts[:-1], ws, tws))
        return rows

    def weighted(self, variants: DataFrame, tested: Callable | None = None) -> DataFrame:
        """Adds ``w``: copies per scenario; with ``tested(cell, w)`` also ``tw``: how often tested."""
        rows = self.cells(tested)
        vector = "array<array<smallint>>"
        shape = f"gen int, in_sample boolean, label int, cuts array<string>, ws {vector}, tws {vector}"
        table = variants.sparkSession.createDataFrame(rows, shape)  # four rows per generator
        joined = self.placed(variants).join(F.broadcast(table), CELL)
        at = F.size(F.filter("cuts", lambda e: e < F.col("place")))
        more = {"w": F.get("ws", at)} | ({"tw": F.get("tws", at)} if tested else {})
        return joined.withColumns(more).drop("cuts", "ws", "tws", "place")


class RowPlan(SetPlan):
    """The same from ``keys(in_sample, kind, key)``, one row per source row and kind of generator; a
    kind names the variants with that key as ``gen:label,...``.

    ``tied`` has the keys where a limit falls among rows that share it: these have no places yet.
    """

    def __init__(self, specs: Sequence[Spec], gens: Sequence[Gen], keys: DataFrame):
        super().__init__(specs, gens, lambda keys: None)
        groups: dict = {}
        for i, s in enumerate(specs):
            groups |= self._groups(i, s)
        if groups:
            self._find_among(keys, groups)

    def _find_among(self, keys: DataFrame, groups: dict[str, tuple[Callable, Callable | None]]) -> None:
        totals = keys.groupBy("in_sample", "kind").count().collect()  # a few hundred kinds
        inside = {}  # no two variants of one kind are in the same group
        for r in totals:
            some = [tuple(map(int, v.split(":"))) for v in r["kind"].split(",")]
            cells = [Cell(gen, r["in_sample"], label) for gen, label in some]
            inside[r["in_sample"], r["kind"]] = {g for g, (f, _) in groups.items() if any(map(f, cells))}
        for g in groups:
            self.counts[g] = sum(r["count"] for r in totals if g in inside[r["in_sample"], r["kind"]])
        left = {}
        for g, (_, take) in groups.items():
            n = self.counts[g] if take is None else take(self.counts)
            if n <= 0 or n >= self.counts[g]:
                if take is not None:
                    self.limits[g] = NOTHING if n <= 0 else EVERYTHING
            else:
                left[g] = ("", n)
        digits = 2
        while left:
            # kinds whose rows are in the same groups are counted together
            heads = sorted({(*k, p) for k, gs in inside.items() for p in {left[g][0] for g in gs if g in left}})
            among = [tuple(sorted(g for g in inside[s, k] if g in left and left[g][0] == p)) for s, k, p in heads]
            sets = sorted(set(among))
            table = [(s, k, p, sets.index(a)) for (s, k, p), a in zip(heads, among)]
            shape = "in_sample boolean, kind string, _head string, _set int"
            small = F.broadcast(keys.sparkSession.createDataFrame(table, shape))
            rows = keys.withColumn("_head", F.substring("key", 1, digits - 2))
            found = rows.join(small, ["in_sample", "kind", "_head"]).groupBy(
                "_set", F.substring("key", 1, digits).alias("_prefix")
            ).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
            slices: dict = {g: {} for g in left}
            for r in found.collect():  # at most 256 rows per slice and set of groups
                for g in sets[r["_set"]]:
                    n, low, high = slices[g].get(r["_prefix"], (0, r["low"], r["high"]))
                    slices[g][r["_prefix"]] = (n + r["n"], min(low, r["low"]), max(high, r["high"]))
            for g, (_, rank) in list(left.items()):
                for prefix in sorted(slices[g]):
                    n, low, high = slices[g][prefix]
                    if rank <= n:
                        break
                    rank -= n
                if low == high:
                    del left[g]
                    self.limits[g] = low + EVERYTHING
                    if rank < n:
                        self.tied.add(low)
                else:
                    left[g] = (prefix, rank)
            digits += 2


def row_plan(specs: Sequence[Spec], gens: Sequence[Gen], table: DataFrame) -> RowPlan:
    """The plan for the variants of ``changes(src_id, in_sample, kind_<method>...)``."""
    if not any(map(is_sampled, specs)):
        return RowPlan(specs, gens, table)
    each = F.array(*[
        F.struct(order_key("order", "src_id", F.lit(m)).alias("key"), F.col(f"kind_{m}").alias("kind"))
        for m in methods_of(gens)
    ])
    rows = table.select("in_sample", F.explode(each).alias("k")).filter(F.col("k.kind").isNotNull())
    return RowPlan(specs, gens, spool(rows.select("in_sample", "k.kind", "k.key"), "keys"))


def is_sampled(s: Spec) -> bool:
    """True if the set depends on counts over the whole table."""
    return bool(s.rebalance or s.perturb or (s.gen and s.fraction < 1))


def weighted_variants(
    corpus: DataFrame,
    specs: Sequence[Spec],
    lex: Lexicons = Lexicons(),
    in_sample: Column | None = None,
    seed: str = "blank",
    redraw: bool = False,
    tested: Callable | None = None,
) -> DataFrame:
    """Row variants with ``w``: per scenario (in the order of ``specs``) the number of copies, and
    with ``tested`` also ``tw``, see ``SetPlan.weighted``.

    ``redraw``: a variant stands for one copy (column ``copy``), and the copies of a blankout row
    drop other words each.
    """
    gens = distinct_gens(specs)
    if tested is None and all(s.base == "sampled" for s in specs):
        # rows outside of the sample are in no set and in no group that is counted
        corpus = corpus.filter(sampled(in_sample))

    def variants_of(keys: list[str]) -> DataFrame:
        methods = ["original", *sorted({g.kind for g in gens})]
        some = F.lit(False)
        for m in methods:
            some = some | order_key("order", F.col("id"), F.lit(m)).isin(keys)
        rows = row_variants(corpus.filter(some), gens, lex, in_sample, seed)
        return rows.filter(F.col("key").isin(keys))

    keys = None
    if any(map(is_sampled, specs)):
        present = row_variants(corpus, gens, lex, in_sample, seed, texts=False)
        keys = spool(present.select(*CELL, "key"), "keys")
    plan = SetPlan(specs, gens, variants_of, keys)
    made = gens
    if redraw:
        made = [replace(g, draws=plan.most_copies(g) - 1) if g.kind == "blankout" else g for g in gens]
    rows = plan.weighted(row_variants(corpus, made, lex, in_sample, seed), tested)
    if not redraw:
        return rows
    # the first copy stays even where no set holds the row: it may be tested
    rows = one_row_per_copy(rows, F.greatest(F.array_max("w"), F.lit(1)))
    if "drawn" not in rows.columns:
        return rows
    other = F.get("drawn", F.col("copy") - 2)
    return rows.withColumn("text", F.coalesce(other, "text")).drop("drawn")


def one_row_per_copy(rows: DataFrame, most: Column, *vectors: str) -> DataFrame:
    """One row per copy: copy c belongs to the scenarios with at least c copies."""
    rows = rows.withColumn("copy", F.explode(copies(most.cast("int"))))

    def present(a: str) -> Column:
        return F.transform(a, lambda n: (n >= F.col("copy")).cast("short"))

    return rows.withColumns({c: present(c) for c in ("w", *vectors)})


def in_any_set(w: Column | str = "w") -> Column:
    return F.exists(w, lambda n: n > 0)


def build_training_set(
    corpus: DataFrame,
    spec: Spec,
    lex: Lexicons = Lexicons(),
    in_sample: Column | None = None,
    seed: str = "blank",
    redraw: bool = False,
) -> DataFrame:
    """One training set as rows (src_id, method, copy, label, text).

    ``redraw``: every copy of a blankout row drops other words.
    """
    return training_set_rows(corpus, [spec], lex, in_sample, seed, redraw).drop("scenario")


def training_set_rows(
    corpus: DataFrame,
    specs: Sequence[Spec],
    lex: Lexicons = Lexicons(),
    in_sample: Column | None = None,
    seed: str = "blank",
    redraw: bool = False,
) -> DataFrame:
    """Several training sets as rows (scenario, src_id, method, copy, label, text)."""
    rows = weighted_variants(corpus, specs, lex, in_sample, seed, redraw)
    columns = ["src_id", "method", "label", "text", *(["copy"] if redraw else [])]
    per_set = rows.select(*columns, F.posexplode("w").alias("s", "n")).filter(F.col("n") > 0)
    names = F.array(*[F.lit(s.scenario) for s in specs])
    return per_set.select(
        F.element_at(names, F.col("s") + 1).alias("scenario"),
        "src_id",
        "method",
        "copy" if redraw else F.explode(copies(F.col("n").cast("int"))).alias("copy"),
        "label",
        "text",
    )
