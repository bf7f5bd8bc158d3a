"""Generated rows as changes of their source row, and classifiers that work on these.

A generated text differs from its source in a few words: some are removed, some added.  Term counts
add up and both classifiers are linear, so nothing has to be done again for the words that stay:

    changes       one row per source row: its words once, and per variant the positions that are
                  removed and the words that are added, written once
    bag           what a training set counts: the words of a source row once per generator kind, with
                  the copy vectors of all its variants added up, and the changes of every variant
    cell_counts   a source row's sums once, those of a variant by its changes

Lexicons are looked up by ``generate.with_tokens``.  Rows are placed in parts of one fold each, in
buckets, so that a part asks for the weights of every term it holds once, for its own fold only.
The work on words is done for whole batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.text import fold_of, label_of, order_key
from counterpoise.operators.generate import (
    ANTONYM_CASES,
    SINGLE_PASS,
    TWO_STAGE,
    Gen,
    Lexicons,
    new_sentiment,
    source_filter,
    strip_atom,
    swap_atom,
    with_tokens,
)
from counterpoise.operators.model import NAIVE_BAYES, RUN, STEP, packed_weights
from counterpoise.session import bucketed, spool

ORIGINAL = -1
ROWS_PER_PART = 1 << 17
ROWS_AT_ONCE = 4096  # whose weights are held as vectors
SEED = 20240229
VARIANTS = "v_gen array<int>, v_label array<int>, v_removed array<array<int>>, v_added array<array<string>>"


@dataclass
class Vectors:
    """Copy vectors by number, and the numbers by cell (gen, in_sample, label), copy and place.

    w, tw   lists of vectors: training and test rows per scenario
    cells   (gen, in_sample, label) -> (limits in ascending order, [numbers between them, per copy])
    """

    w: list[tuple[int, ...]] = field(default_factory=list)
    tw: list[tuple[int, ...]] = field(default_factory=list)
    cells: dict = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    def number(self, w: Sequence[int], tw: Sequence[int]) -> int:
        pair = (tuple(w), tuple(tw))
        if pair not in self.known:
            self.known[pair] = len(self.w)
            self.w.append(pair[0])
            self.tw.append(pair[1])
        return self.known[pair]


def methods_of(gens: Sequence[Gen]) -> list[str]:
    return ["original", *sorted({g.kind for g in gens})]


def _key(method: str) -> Column:
    return order_key("order", "src_id", F.lit(method))


def _with_keys(rows: DataFrame, methods: Sequence[str]) -> DataFrame:
    """The order in which the variants of a row are taken, the same for all of one kind."""
    return rows.withColumns({f"key_{m}": _key(m) for m in methods})


# ---------------------------------------------------------------- variants


def changes(
    corpus: DataFrame,
    gens: Sequence[Gen],
    lex: Lexicons,
    in_sample: Column,
    folds: int,
    seed: str = "blank",
    outside: Sequence[bool] = (),
    redrawn: bool = False,
) -> DataFrame:
    """(src_id, fold, in_sample, label, terms, v_..., kind_<method>) of ``corpus(id, sentiment, text)``:
    one row per source row; lists over its variants but the original.

    ``kind_<method>`` names the variants made by one kind of generator, as ``gen:label`` in a row.
    ``outside``: whether a generator is wanted for rows outside of the sample too.  ``redrawn``: adds
    ``name`` and ``may_<gen>``, the positions that a blankout may drop, for the draws of further copies.
    """
    methods = methods_of(gens)
    id_type = corpus.schema["id"].dataType.simpleString()
    rows = corpus.select("id", "sentiment", "text", in_sample.alias("in_sample"))
    more = ["lowered"] if any(g.kind == "similar" for g in gens) else []
    made = with_tokens(rows, gens, lex, more)
    labels = [F.when(source_filter(g), label_of(new_sentiment(g))) for g in gens]
    taken = made.select(
        F.col("id").alias("src_id"),
        F.col("id").cast("string").alias("name"),
        fold_of("id", folds=folds).alias("fold"),
        "in_sample",
        label_of("sentiment").alias("label"),
        F.array(*labels).cast("array<int>").alias("labels"),
        "toks",
    )
    kinds = "".join(f", kind_{m} string" for m in methods)
    shape = f"src_id {id_type}, fold int, in_sample boolean, label int, terms array<string>, {VARIANTS}{kinds}"
    if redrawn:
        shape += "".join(f", {c} array<int>" for c in _droppable(gens)) + ", name string"
    maker = _Maker(list(gens), seed, list(outside) or [True] * len(gens), redrawn)
    return taken.mapInArrow(maker, shape)


def _droppable(gens: Sequence[Gen]) -> dict[str, Gen]:
    """Names of the columns with the positions that a blankout may drop."""
    return {_may_name(g): g for g in gens if g.kind == "blankout"}


def _may_name(g: Gen) -> str:
    return f"may_{int(g.protect)}{int(g.senti)}"


def placed(rows: DataFrame, n_rows: int, folds: int) -> DataFrame:
    """``rows`` written once in buckets, each one part: rows of one fold."""
    each = max(1, -(-n_rows // (folds * ROWS_PER_PART)))
    parts = folds * each
    # numbers that fall into different buckets
    falls = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    tried = rows.sparkSession.range(64 * parts).select(F.col("id").cast("int"), falls.alias("at"))
    found = {r["at"]: r["id"] for r in tried.groupBy("at").agg(F.min("id").alias("id")).collect()}
    numbers = F.array(*[F.lit(found.get(i, i)) for i in range(parts)])
    part = F.col("fold") * each + F.pmod(F.monotonically_increasing_id(), F.lit(each)).cast("int")
    return bucketed(rows.withColumn("part", F.get(numbers, part)).repartition(parts, "part"), "part", parts)


def _counts(at, size):
    import numpy as np

    return np.bincount(at, minlength=size)


def _joined(*arrays):
    """One array of strings; those without any may come without offsets."""
    import pyarrow as pa

    return pa.concat_arrays([a for a in arrays if len(a)] or [pa.array([], pa.string())])


def _lists(values, counts):
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


@dataclass
class _Maker:
    gens: list
    seed: str
    outside: list
    redrawn: bool

    def __call__(self, batches):
        for batch in batches:
            if batch.num_rows:
                yield self.made(batch)

    def made(self, batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        R = batch.num_rows
        toks = batch.column("toks")
        length = pc.fill_null(toks.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = toks.flatten()
        words, N = flat.field("w"), len(flat)
        row = np.repeat(np.arange(R), length)
        pos = np.arange(N) - np.repeat(np.cumsum(length) - length, length)
        names = [f.name for f in flat.type if f.name not in ("pos", "w")]
        has = {n: flat.field(n).is_valid().to_numpy(zero_copy_only=False) for n in names}
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        n_filled = _counts(row[filled], R)
        # all words that may be added, one list after another
        texts = [n for n in names if pa.types.is_string(flat.field(n).type)]
        first = {n: i * N for i, n in enumerate(texts)}
        pool = _joined(*[flat.field(n) for n in texts])
        trimmed = pc.utf8_trim(pool, " ")
        blank = pc.fill_null(pc.equal(trimmed, ""), False).to_numpy(zero_copy_only=False)
        plain = ~blank & ~pc.fill_null(pc.match_substring(pool, " "), False).to_numpy(zero_copy_only=False)

        in_sample = batch.column("in_sample").to_numpy(zero_copy_only=False).astype(bool)
        labels = batch.column("labels").flatten()
        G = len(self.gens)
        wanted = labels.is_valid().to_numpy(zero_copy_only=False).reshape(R, G)
        label = pc.fill_null(labels, -1).to_numpy(zero_copy_only=False).reshape(R, G)
        tokens = _Tokens(R, row, pos, length, filled, n_filled, has, first, blank)

        V = {k: [] for k in ("row", "gen", "label")}
        C = {k: [] for k in ("var", "tok", "new")}
        count = 0

        def add(i, ok, tok, new):
            nonlocal count
            rows = np.flatnonzero(ok)
            number = np.full(R, -1)
            number[rows] = count + np.arange(len(rows))
            count += len(rows)
            V["row"].append(rows)
            V["gen"].append(np.full(len(rows), i))
            V["label"].append(label[rows, i])
            kept = ok[row[tok]]
            C["var"].append(number[row[tok[kept]]])
            C["tok"].append(tok[kept])
            C["new"].append(new[kept])

        asked = [wanted[:, i] & (in_sample | self.outside[i]) for i in range(G)]
        orders = _Orders(batch.column("name"), tokens, self.seed)
        for i, g in enumerate(self.gens):
            if g.kind != "blankout":
                hit, tok, new = tokens.antonym(g) if g.kind == "antonym" else tokens.similar(g)
                add(i, asked[i] & hit & ~tokens.empty(tok, new), tok, new)
                continue
            may = tokens.may_drop(g)
            hit = asked[i] & (length - g.k >= g.min_left) & (_counts(row[may], R) > 0) & (g.k > 0)
            tok = orders.first(may, hit, g.k, g.draw)
            none = np.full(len(tok), -1)
            add(i, hit & ~tokens.empty(tok, none), tok, none)

        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        V, C = {k: cat(v) for k, v in V.items()}, {k: cat(v) for k, v in C.items()}
        out = [batch.column(c) for c in ("src_id", "fold", "in_sample", "label")]
        kinds = self.kinds(V, R, batch.column("label").to_numpy(zero_copy_only=False))
        order = np.argsort(V["row"], kind="stable")
        place = np.empty(count, dtype=np.int64)
        place[order] = np.arange(count)
        V = {k: v[order] for k, v in V.items()}
        removed, added = _word_lists(tokens, words, pool, plain, V["row"], place[C["var"]], C["tok"], C["new"])
        per_row = _counts(V["row"], R)
        terms = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), words,
            mask=toks.is_null() if toks.null_count else None,
        )
        ints = [_lists(pa.array(V[k].astype(np.int32)), per_row) for k in ("gen", "label")]
        out += [terms, *ints, _lists(removed, per_row), _lists(added, per_row), *kinds]
        names = ["src_id", "fold", "in_sample", "label", "terms"]
        names += ["v_gen", "v_label", "v_removed", "v_added"]
        names += [f"kind_{m}" for m in methods_of(self.gens)]
        if self.redrawn:
            for c, g in _droppable(self.gens).items():
                may = tokens.may_drop(g)
                out.append(_lists(pa.array(pos[may].astype(np.int32)), _counts(row[may], R)))
                names.append(c)
            out.append(batch.column("name"))
            names.append("name")
        return pa.RecordBatch.from_arrays(out, names=names)

    def kinds(self, V, R, label):
        import numpy as np
        import pyarrow as pa

        rnd = np.random.default_rng(SEED).integers(1, 1 << 62, size=(len(self.gens) + 1, 2), dtype=np.uint64)
        out = [pa.array([f"{ORIGINAL}:0", f"{ORIGINAL}:1"]).take(pa.array(label))]
        method = np.array([g.kind for g in self.gens])
        for m in methods_of(self.gens)[1:]:
            mine = np.flatnonzero(method[V["gen"]] == m)
            mine = mine[np.argsort(V["row"][mine], kind="stable")]
            rows, gen, lab = V["row"][mine], V["gen"][mine], V["label"][mine]
            name = np.full(R, -1)
            texts = []
            if len(rows):
                start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                ends = np.append(start[1:], len(rows))
                _, example, which = np.unique(
                    np.add.reduceat(rnd[gen, lab], start), return_index=True, return_inverse=True
                )
                name[rows[start]] = which
                for e in example:
                    some = slice(start[e], ends[e])
                    texts.append(",".join(f"{g}:{x}" for g, x in sorted(zip(gen[some].tolist(), lab[some].tolist()))))
            found = pa.array(name, mask=name < 0)
            out.append(pa.array(texts, pa.string()).take(found))
        return out


def _word_lists(tokens, words, pool, plain, v_row, var, tok, new):
    """Per variant the removed positions and the added words."""
    import numpy as np
    import pyarrow as pa

    n = len(v_row)
    order = np.lexsort((tok, var))
    var, tok, new = var[order], tok[order], new[order]
    # where a word is empty, or a new one is none or several, words are found by making the text
    odd = (_counts(tokens.row[~tokens.filled], tokens.R) > 0)[v_row]
    with_new = new >= 0
    odd |= _counts(var[with_new][~plain[new[with_new]]], n) > 0
    extra, extra_var, extra_tok, extra_of = [], [], [], []
    if odd.any():
        ends = np.cumsum(tokens.length)
        for v in np.flatnonzero(odd):
            r = v_row[v]
            a, b = int(ends[r] - tokens.length[r]), int(ends[r])
            mine = slice(*np.searchsorted(var, [v, v + 1]))
            own = dict(zip(tok[mine].tolist(), new[mine].tolist()))
            own = {t: None if p < 0 else pool[p].as_py() for t, p in own.items()}
            made = [own.get(t, words[t].as_py()) for t in range(a, b)]
            text = " ".join(w for w in made if w is not None).strip(" ")
            terms = text.split(" ")
            extra += terms
            extra_of += [v] * len(terms)
            extra_var += [v] * (b - a)
            extra_tok += list(range(a, b))
        kept = ~odd[var]
        var, tok, new, with_new = var[kept], tok[kept], new[kept], with_new[kept]
    removed_var = np.concatenate([var, np.array(extra_var, dtype=np.int64)])
    removed_tok = np.concatenate([tok, np.array(extra_tok, dtype=np.int64)])
    added_var = np.concatenate([var[with_new], np.array(extra_of, dtype=np.int64)])
    added = np.concatenate([new[with_new], len(pool) + np.arange(len(extra))])
    pool = _joined(pool, pa.array(extra, pa.string()))
    r, a = np.argsort(removed_var, kind="stable"), np.argsort(added_var, kind="stable")
    positions = pa.array(tokens.pos[removed_tok[r]].astype(np.int32))
    return (
        _lists(positions, _counts(removed_var, n)),
        _lists(pool.take(pa.array(added[a].astype(np.int64))), _counts(added_var, n)),
    )


class _Tokens:
    """The words of a batch of rows, one after another, and what generators do with them: whether a
    row is changed, the changed words, and the number of the new word in the pool or -1."""

    def __init__(self, R, row, pos, length, filled, n_filled, has, first, blank):
        self.R, self.row, self.pos, self.length = R, row, pos, length
        self.filled, self.n_filled, self.has, self.first, self.blank = filled, n_filled, has, first, blank

    def number(self, mask):
        return _counts(self.row[mask], self.R)

    def leading(self, mask):
        """The first word of every row where ``mask`` holds."""
        import numpy as np

        at = np.flatnonzero(mask)
        return at[np.append(True, self.row[at[1:]] != self.row[at[:-1]])] if len(at) else at

    def antonym(self, g):
        import numpy as np

        strip, swap = strip_atom(g), swap_atom(g)
        S, X = self.has[strip], self.has[swap]
        stripped = self.number(S) > 0
        hit = stripped | (self.number(X) > 0)
        mode = ANTONYM_CASES[g.case][0]
        if mode == SINGLE_PASS:
            tok, by_strip = np.flatnonzero(S | X), S
        else:
            by_strip = stripped[self.row]
            chosen = np.where(by_strip, S, X)
            tok = np.flatnonzero(chosen) if mode == TWO_STAGE else self.leading(chosen)
        if g.prefilter:
            hit &= self.number(self.has["negated"]) + self.number(self.has["swap_low"]) <= 1
        return hit, tok, np.where(by_strip[tok], self.first[strip], self.first[swap]) + tok

    def similar(self, g):
        import numpy as np

        atom = f"similar_{g.lexicon}"
        A, low = self.has[atom], self.has["lowered"]
        hit = self.number(A) > 0
        swapped = A
        if g.words == "one":
            swapped = np.zeros(len(A), dtype=bool)
            swapped[self.leading(A)] = True
        tok = np.flatnonzero(swapped | low)
        return hit, tok, np.where(swapped[tok], self.first[atom], self.first["lowered"]) + tok

    def may_drop(self, g):
        import numpy as np

        ok = np.ones(len(self.row), dtype=bool)
        if g.protect:
            ok &= ~self.has["protected"]
        if g.senti:
            ok &= ~self.has["senti_raw"]
        return ok

    def empty(self, tok, new):
        """Rows whose text would be empty."""
        with_new = new >= 0
        left = self.n_filled - self.number(tok[self.filled[tok]])
        left = left + self.number(tok[with_new][~self.blank[new[with_new]]])
        return left <= 0


class _Orders:
    """Random but repeatable orders of the words of a row, as ``order_key`` gives them."""

    def __init__(self, names, tokens, seed):
        self.names, self.tokens, self.seed = names.to_pylist(), tokens, seed
        self.held = {}

    def first(self, may, rows, k, draw):
        """The first ``k`` words that may be dropped of some rows, in ascending order."""
        import numpy as np

        t = self.tokens
        at = np.flatnonzero(may & rows[t.row])
        if draw not in self.held:
            n = len(t.row)
            self.held[draw] = np.zeros(n, bool), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        made, high, low = self.held[draw]
        new = at[~made[at]]
        if len(new):
            digests = np.frombuffer(self.digests(new, draw), dtype=">u8").reshape(-1, 2)
            made[new], high[new], low[new] = True, digests[:, 0], digests[:, 1]
        if not len(at):
            return at
        order = at[np.lexsort((low[at], high[at], t.row[at]))]
        rows = t.row[order]
        start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        return np.sort(order[rank < k])

    def digests(self, at, draw):
        from hashlib import md5

        salt = self.seed if draw == 0 else f"{self.seed}/{draw}"
        heads: dict = {}
        out = []
        for r, p in zip(self.tokens.row[at].tolist(), self.tokens.pos[at].tolist()):
            if r not in heads:
                name = self.names[r]
                heads[r] = f"{salt}:" if name is None else f"{salt}:{name}:"
            out.append(md5(f"{heads[r]}{p}".encode()).digest())
        return b"".join(out)


# ---------------------------------------------------------------- copy vectors of a batch


class _Rows:
    """A batch of rows with the numbers of their variants' copy vectors, originals first."""

    def __init__(self, batch, vectors: Vectors, gens: Sequence[Gen], seed: str | None = None):
        import numpy as np
        import pyarrow as pa

        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks()
            column = lambda c: batch.column(c).combine_chunks()
        else:
            column = batch.column
        ints = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
        R = self.R = batch.num_rows
        terms = column("terms")
        self.length = ints(terms.value_lengths())
        self.terms = terms.flatten()
        self.fold, label = ints(column("fold")), ints(column("label"))
        sampled = column("in_sample").to_numpy(zero_copy_only=False).astype(bool)
        per_row = ints(column("v_gen").value_lengths())
        made = {k: ints(column(f"v_{k}").flatten()) for k in ("gen", "label")}
        v_row = np.repeat(np.arange(R), per_row)
        self.row = np.concatenate([np.arange(R), v_row])
        self.gen = np.concatenate([np.full(R, ORIGINAL), made["gen"]])
        self.label = np.concatenate([label, made["label"]])
        removed, added = column("v_removed").flatten(), column("v_added").flatten()
        none = np.zeros(R, dtype=np.int64)
        self.n_removed = np.concatenate([none, ints(removed.value_lengths())])
        self.n_added = np.concatenate([none, ints(added.value_lengths())])
        start = np.cumsum(self.length) - self.length
        self.removed = ints(removed.flatten()) + np.repeat(start[self.row], self.n_removed)
        self.added = added.flatten()

        self.number = np.full(len(self.row), -1)
        most = np.ones(len(self.row), dtype=np.int64)
        others = {}  # of blankouts with further copies: variants, and the numbers of all copies
        w = np.array(vectors.w).any(axis=1)
        keys = {}
        cell = ((self.gen + 1) * 2 + sampled[self.row]) * 2 + self.label
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            gen, s, x = int(c) // 4 - 1, bool(c // 2 % 2), int(c % 2)
            cuts, numbers = vectors.cells[(gen, s, x)]
            between = np.zeros(len(at), dtype=np.int64)
            if cuts:
                m = "original" if gen < 0 else gens[gen].kind
                if m not in keys:
                    keys[m] = np.array(column(f"key_{m}").to_pylist(), dtype="S64")
                between = np.searchsorted(np.array(cuts, dtype="S64"), keys[m][self.row[at]])
            table = np.array(numbers).reshape(len(numbers), -1)
            self.number[at] = table[between, 0]
            if seed is not None and x == 1 and gen >= 0 and gens[gen].kind == "blankout":
                most[at] = np.maximum(1, w[table].sum(axis=1))[between]
                others[gen, s] = at, table[between]
        if others:
            self._draw(column, gens, seed, most, others)
        methods = methods_of(gens)
        self.method = np.array([0] + [methods.index(g.kind) for g in gens])[self.gen + 1]

    def _draw(self, column, gens, seed, most, others):
        """Adds the further copies of blankout rows, each with other words dropped."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        R, N = self.R, len(self.terms)
        row = np.repeat(np.arange(R), self.length)
        start = np.cumsum(self.length) - self.length
        filled = pc.not_equal(self.terms, "").to_numpy(zero_copy_only=False)
        none = np.zeros(0, dtype=bool)
        tokens = _Tokens(R, row, np.arange(N) - start[row], self.length, filled, _counts(row[filled], R), {}, {}, none)
        orders = _Orders(column("name"), tokens, seed)
        v_row, v_gen, number, var, tok = [], [], [], [], []
        count = 0
        for (i, _), (at, numbers) in others.items():
            g = gens[i]
            may = np.zeros(N, dtype=bool)
            may_drop = column(_may_name(g))
            size = may_drop.value_lengths().to_numpy(zero_copy_only=False)
            may[may_drop.flatten().to_numpy(zero_copy_only=False) + np.repeat(start, size)] = True
            for copy in range(2, int(most[at].max(initial=1)) + 1):
                again = at[most[at] >= copy]
                rows = np.zeros(R, dtype=bool)
                rows[self.row[again]] = True
                drawn = orders.first(may, rows, g.k, g.draw + copy - 1)
                # the first text where this one would be empty
                bad = rows & tokens.empty(drawn, np.full(len(drawn), -1))
                drawn = np.concatenate([drawn[~bad[row[drawn]]], orders.first(may, bad, g.k, g.draw)])
                of_row = np.zeros(R, dtype=np.int64)
                of_row[self.row[again]] = count + np.arange(len(again))
                count += len(again)
                v_row.append(self.row[again])
                v_gen.append(np.full(len(again), i))
                number.append(numbers[most[at] >= copy, copy - 1])
                var.append(of_row[row[drawn]])
                tok.append(drawn)
        if not count:
            return
        v_row, v_gen, number, var, tok = map(np.concatenate, (v_row, v_gen, number, var, tok))
        no_words = pa.array([], pa.string())
        removed, added = _word_lists(tokens, self.terms, no_words, none, v_row, var, tok, np.full(len(tok), -1))
        ints = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
        n_removed, n_added = ints(removed.value_lengths()), ints(added.value_lengths())
        at = ints(removed.flatten()) + np.repeat(start[v_row], n_removed)
        self.row, self.gen = np.append(self.row, v_row), np.append(self.gen, v_gen)
        self.label = np.append(self.label, np.ones(count, dtype=np.int64))
        self.number = np.append(self.number, number)
        self.n_removed, self.n_added = np.append(self.n_removed, n_removed), np.append(self.n_added, n_added)
        self.removed, self.added = np.append(self.removed, at), _joined(self.added, added.flatten())


def _some(values, counts, kept):
    """The entries of the lists that are kept, and how many each of these has."""
    import numpy as np

    return np.flatnonzero(np.repeat(kept, counts)), counts[kept]


def _sums(values, counts):
    """Sums over consecutive lists of rows of a matrix."""
    import numpy as np

    out = np.zeros((len(counts), values.shape[1]))
    some = counts > 0
    if some.any():
        start = np.cumsum(counts) - counts
        out[some] = np.add.reduceat(values, start[some], axis=0)
    return out


# ---------------------------------------------------------------- training


def bag(table: DataFrame, gens: Sequence[Gen], vectors: Vectors, seed: str | None = None) -> DataFrame:
    """``model.training_stats`` of all variants: (term, fold, label, pattern, w, c).

    ``seed``: every copy of a blankout row of label 1 drops other words.
    """
    gens, methods = list(gens), methods_of(gens)
    shape = "term string, fold int, label int, pattern bigint, w array<int>, c bigint"

    def count(batches):
        import numpy as np
        import pyarrow as pa

        w = np.array(vectors.w, dtype=np.int64)
        used = w.any(axis=1)
        rnd = np.random.default_rng(SEED).integers(1, 1 << 62, size=len(w), dtype=np.int64)
        seen, docs = {}, {}

        def out(term, fold, label, pattern, c, w=None):
            n = len(pattern)
            w = pa.nulls(n, pa.list_(pa.int32())) if w is None else pa.array(w, pa.list_(pa.int32()))
            arrays = [term, pa.array(fold, pa.int32()), pa.array(label, pa.int32()), pa.array(pattern, pa.int64()), w,
                      pa.array(c, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["term", "fold", "label", "pattern", "w", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, vectors, gens, seed)
            coded = _joined(rows.terms, rows.added).dictionary_encode()
            words = coded.dictionary
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own, new = code[: len(rows.terms)], code[len(rows.terms):]
            kept = used[rows.number]
            # the words of a row once per kind of generator and label, for all of its variants
            at = np.flatnonzero(kept)
            group = (rows.row[at] * len(methods) + rows.method[at]) * 2 + rows.label[at]
            order = np.argsort(group, kind="stable")
            at, group = at[order], group[order]
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            ends = np.append(start[1:], len(at))
            pattern = np.add.reduceat(rnd[rows.number[at]], start) if len(at) else np.zeros(0, np.int64)
            row, label = group[start] // (2 * len(methods)), group[start] % 2
            for i in np.unique(pattern, return_index=True)[1]:
                seen.setdefault(int(pattern[i]), w[rows.number[at[start[i]:ends[i]]]].sum(axis=0).tolist())
            for v in np.unique(rows.number[at]):
                seen.setdefault(int(rnd[v]), w[v].tolist())
            keys = {"fold": [rows.fold[row]], "label": [label], "pattern": [pattern]}
            offset = np.cumsum(rows.length) - rows.length
            size = rows.length[row]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            codes, sizes = [own[np.repeat(offset[row], size) + inside]], [size]
            signs = [np.ones(len(row), dtype=np.int64)]
            for values, counts, sign in ((own[rows.removed], rows.n_removed, -1), (new, rows.n_added, 1)):
                taken, size = _some(values, counts, kept)
                codes.append(values[taken])
                sizes.append(size)
                v = np.flatnonzero(kept)
                keys["fold"].append(rows.fold[rows.row[v]])
                keys["label"].append(rows.label[v])
                keys["pattern"].append(rnd[rows.number[v]])
                signs.append(np.full(len(v), sign))
            fold, label2, pat = (np.concatenate(keys[k]) for k in ("fold", "label", "pattern"))
            sizes, signs = np.concatenate(sizes), np.concatenate(signs)
            # one number for fold, label and pattern, and counts of equal words under it
            pats, p = np.unique(pat, return_inverse=True)
            kind = (fold * 2 + label2) * len(pats) + p
            named, kind = np.unique(kind, return_inverse=True)
            both = np.repeat(kind, sizes) * len(words) + np.concatenate(codes)
            found, which = np.unique(both, return_inverse=True)
            c = np.bincount(which, weights=np.repeat(signs, sizes), minlength=len(found)).astype(np.int64)
            some = c != 0
            found, c = found[some], c[some]
            which = named[found // max(1, len(words))]
            yield out(words.take(pa.array(found % max(1, len(words)))), which // len(pats) // 2, which // len(pats) % 2,
                      pats[which % len(pats)] if len(pats) else which, c)
            for k in zip(rows.fold[row].tolist(), label.tolist(), pattern.tolist()):
                docs[k] = docs.get(k, 0) + 1
        # rows without a term count the rows and hold the vectors, also of those that only changes have
        rest = {p for p in seen} - {p for _, _, p in docs}
        ends = [(*k, c) for k, c in docs.items()] + [(0, 0, p, 0) for p in rest]
        if ends:
            fold, label, pattern, c = zip(*ends)
            yield out(pa.nulls(len(ends), pa.string()), fold, label, pattern, c, [seen[p] for p in pattern])

    rows = _with_keys(table.filter(F.col("terms").isNotNull()), methods)
    counted = rows.mapInArrow(count, shape).groupBy("term", "fold", "label", "pattern", "w")
    return counted.agg(F.sum("c").alias("c")).filter(F.col("term").isNull() | (F.col("c") != 0))


# ---------------------------------------------------------------- scoring


def cell_counts(
    table: DataFrame,
    stats: DataFrame,
    gens: Sequence[Gen],
    vectors: Vectors,
    classifier: str,
    constants: dict,
    seed: str | None = None,
) -> DataFrame:
    """(fold, label, tw, n, hits): test rows and how many of them are predicted as 1, vectors over
    scenarios, in parts.

    ``constants``: arrays over folds and scenarios of the models that leave a fold out.
    """
    gens, methods = list(gens), methods_of(gens)
    n = len(vectors.w[0])
    weights = spool(packed_weights(stats, n, classifier), "weights")
    rows = table.filter(F.col("terms").isNotNull())
    # every part asks once for a term, and gets the weights for its own fold
    words = F.explode(F.concat("terms", F.flatten("v_added"))).alias("term")
    asked = rows.select("part", "fold", words).distinct()
    by_fold = F.col("by_fold")
    own = F.coalesce(F.try_element_at(by_fold, F.col("fold")), F.try_element_at(by_fold, F.lit(-1)))
    told = asked.join(weights, "term").select("part", "term", own.alias("x"))
    told = told.filter(F.octet_length("x") > 0).select(F.col("part").alias("for_part"), "term", "x")
    bayes = classifier == NAIVE_BAYES

    def count(rows, told):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["fold", "label", "tw", "n", "hits"]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64())]
        found: dict = {}
        packed = told.column("x").combine_chunks()
        size = pc.fill_null(pc.binary_length(packed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.frombuffer(b"".join(packed.to_pylist()), dtype=RUN)
        runs, values = held["size"].astype(np.int64), held["value"].copy()
        ends = np.concatenate(([0], np.cumsum(size // held.itemsize)))
        known = told.column("term").combine_chunks()
        tested = np.array(vectors.tw, dtype=np.int64).any(axis=1)

        def dense(which):
            """Vectors of some weights; number 0 stands for no weight."""
            which = which[which > 0] - 1
            size = ends[which + 1] - ends[which]
            at = np.repeat(ends[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            return np.vstack([np.zeros(n), np.repeat(values[at], runs[at]).reshape(-1, n)])

        for start in range(0, rows.num_rows, ROWS_AT_ONCE):
            some = _Rows(rows.slice(start, ROWS_AT_ONCE), vectors, gens, seed)
            place = pc.index_in(_joined(some.terms, some.added), value_set=known)
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            used, place = np.unique(np.append(0, place), return_inverse=True)
            matrix, place = dense(used), place[1:]
            own, new = place[: len(some.terms)], place[len(some.terms):]
            kept = tested[some.number]
            m = _sums(matrix[own], some.length)[some.row[kept]]
            for codes, counts, sign in ((own[some.removed], some.n_removed, -1), (new, some.n_added, 1)):
                taken, size = _some(codes, counts, kept)
                m += sign * _sums(matrix[codes[taken]], size)
            fold, label, number = some.fold[some.row[kept]], some.label[kept], some.number[kept]
            docs0, docs1 = constants["docs"][0][fold], constants["docs"][1][fold]
            if bayes:
                length = (some.length[some.row] - some.n_removed + some.n_added)[kept]
                m += constants["prior"][fold] + length[:, None] * constants["per_word"][fold]
                # margins are rounded to nine digits; a class without training rows is never predicted
                one = np.where(docs1 == 0, False, np.where(docs0 == 0, True, m >= constants["least"]))
            else:
                one = STEP * m / np.maximum(docs0 + docs1, 1) > 0
            by = (fold * 2 + label) * len(vectors.tw) + number
            order = np.argsort(by, kind="stable")
            keys, at, size = np.unique(by[order], return_index=True, return_counts=True)
            hits = np.add.reduceat(one[order].astype(np.int64), at, axis=0) if len(at) else []
            for k, c, h in zip(keys.tolist(), size.tolist(), hits):
                before = found.get(k)
                found[k] = (c, h) if before is None else (before[0] + c, before[1] + h)
        key = np.array(list(found), dtype=np.int64)
        t = len(vectors.tw)
        columns = [key // t // 2, key // t % 2, [list(vectors.tw[k]) for k in (key % t).tolist()],
                   [c for c, _ in found.values()], [h.tolist() for _, h in found.values()]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=names)

    columns = ["part", "fold", "in_sample", "label", "terms"]
    columns += [c for c in table.columns if c.startswith(("v_", "may_")) or c == "name"]
    keyed = _with_keys(rows, methods).select(*columns, *[f"key_{m}" for m in methods])
    shape = "fold int, label int, tw array<int>, n bigint, hits array<bigint>"
    return keyed.groupBy("part").cogroup(told.groupBy("for_part")).applyInArrow(count, shape)
