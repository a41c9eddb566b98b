"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs (its lines that are not blank) are digested, each distinct one once. A sketch
has three rows of `WIDTH` cells; a digest enters one cell of each row, which keep a count, the XOR
of the digests and the XOR of their checks. Sketches of two versions subtract cell by cell, so that
what both have cancels out. Peeling then recovers the differing digests: a cell that holds a single
one names it, and its removal frees further cells.

Where peeling gets stuck, the pair goes on with a larger sketch: its digests are dealt by another
hash over `SPREAD` times as many parts, each with a sketch of its own. Only parts that got stuck are
dealt again, so the work follows the number of paragraphs, and every pair is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sourcetrust.llm.tables import Workspace, numbered

WIDTH = 16  # cells of a row of a sketch: a power of two
ROWS = 3
ROUNDS = 5  # times that each row is searched for single digests
SPREAD = 8  # parts into which the digests of a stuck sketch are dealt


def _hash60(value: Column) -> Column:
    """The first 60 bits of the MD5."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


def paragraph_digests(text: Column) -> Column:
    """Digests of the distinct lines of a text that are not blank, without the blanks at their ends."""
    lines = F.transform(F.split(text, "[\\n\\r]+"), lambda x: F.trim(x))
    return F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")), _hash60)


def _entry(digest: Column, n: Column) -> Column:
    """A digest with its sign, its check and its place in each row (four bits of it for each)."""
    places = [F.shiftright(digest, 4 * r).bitwiseAND(F.lit(WIDTH - 1)).cast("int").alias(f"s{r}") for r in range(ROWS)]
    return F.struct(n.alias("n"), digest.alias("x"), _hash60(digest).alias("c"), *places)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, as the element of an array."""
    return F.transform(F.array(value), use)[0]


def _moved(cell: Column, entries: Column, way: int) -> Column:
    """A cell with entries put in (way 1) or taken out (-1)."""
    sign = lambda e: e["n"] if way > 0 else -e["n"]
    return F.aggregate(entries, cell, lambda a, e: F.struct(
        (a["n"] + sign(e)).alias("n"), a["x"].bitwiseXOR(e["x"]).alias("x"), a["c"].bitwiseXOR(e["c"]).alias("c")
    ))


def sketch(digests: Column) -> Column:
    """Cells (n, x, c) of the digests, row after row."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))

    def row(entries: Column, r: int) -> Column:
        own = lambda i: F.filter(entries, lambda e: e[f"s{r}"] == i)
        return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: _moved(empty, own(i), 1))

    entries = F.transform(digests, lambda d: _entry(d, F.lit(1)))
    return _named(entries, lambda es: F.concat(*[row(es, r) for r in range(ROWS)]))


def shown(cells: Column) -> Column:
    """The sketch as text: its cells as n.x.c in hexadecimal digits, an empty one as nothing."""
    digits = lambda v: F.lower(F.hex(v))
    cell = lambda e: F.when(e["n"] == 0, "").otherwise(
        F.concat_ws(".", digits(e["n"]), digits(e["x"]), digits(e["c"]))
    )
    return F.array_join(F.transform(cells, cell), " ")


def subtracted(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct(
        (a["n"] - b["n"]).alias("n"), a["x"].bitwiseXOR(b["x"]).alias("x"), a["c"].bitwiseXOR(b["c"]).alias("c")
    ))


def peeled(cells: Column) -> Column:
    """Struct of `rows` (all empty if peeling came to its end) and `found`: digests with n 1 (left) or -1 (right).

    The rows of the sketch take turns: a digest lies in one cell of a row, so none is removed twice.
    """
    names = [f"r{r}" for r in range(ROWS)]
    start = F.struct(
        *[F.slice(cells, r * WIDTH + 1, WIDTH).alias(names[r]) for r in range(ROWS)],
        F.array().cast("array<struct<n:int,x:bigint>>").alias("found"),
    )

    def turn(r: int) -> Callable[[Column], Column]:
        return lambda state: searched(state, r)

    def searched(state: Column, r: int) -> Column:
        def taken(single: Column) -> Column:
            def left(k: int) -> Column:
                hits = lambda i: F.filter(single, lambda s: s[f"s{k}"] == i)
                return F.transform(state[names[k]], lambda e, i: _moved(e, hits(i), -1)).alias(names[k])

            kept = [left(k) for k in range(ROWS)]
            found = F.concat(state["found"], F.transform(single, lambda s: F.struct(s["n"].alias("n"), s["x"].alias("x"))))
            return F.when(F.size(single) == 0, state).otherwise(F.struct(*kept, found.alias("found")))

        alone = F.filter(state[names[r]], lambda e: F.abs(e["n"]) == 1)
        entries = F.transform(alone, lambda e: F.struct(_entry(e["x"], e["n"]).alias("e"), e["c"].alias("c")))
        true = F.filter(entries, lambda t: t["e"]["c"] == t["c"])
        return _named(F.transform(true, lambda t: t["e"]), taken)

    def turns(state: Column, _: Column) -> Column:
        for r in range(ROWS):
            state = _named(state, turn(r))
        return state

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turns)


def difference(left: Column, right: Column) -> Column:
    """Struct of two sketches: `done`, `gone` and `added` (digests of the left and of the right alone)."""
    def sides(state: Column) -> Column:
        digests = lambda sign: F.transform(F.filter(state["found"], lambda e: e["n"] == sign), lambda e: e["x"])
        return F.struct(
            F.forall(F.concat(*[state[f"r{r}"] for r in range(ROWS)]), lambda e: (e["n"] == 0) & (e["x"] == 0)).alias("done"),
            digests(1).alias("gone"), digests(-1).alias("added"),
        )

    return _named(peeled(subtracted(left, right)), sides)


class Comparison:
    """The expressions of one call: they are long, and building them takes seconds."""

    def __init__(self, space: Workspace, key: list[str]):
        self.space, self.key = space, key
        self.sketch, self.difference = sketch(F.col("_set")), difference(F.col("_left"), F.col("_right"))

    def sketched(self, rows: DataFrame, names: dict[str, str]) -> DataFrame:
        """Adds the cells of arrays."""
        for array, cells in names.items():
            rows = rows.withColumn("_set", F.col(array)).withColumn(cells, self.sketch).drop("_set")
        return rows

    def compared(self, rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
        """Adds the difference of two columns of cells."""
        named = rows.withColumns({"_left": F.col(left), "_right": F.col(right)})
        return named.withColumn(out, self.difference).drop("_left", "_right")

    def larger(self, stuck: DataFrame) -> DataFrame:
        """key, gone, added of pairs of digest arrays (_l, _r), by sketches that grow until none is stuck."""
        key, done, depth = self.key, None, 0
        while depth == 0 or not stuck.isEmpty():
            depth += 1
            of = lambda c: F.filter(c, lambda d: F.pmod(F.xxhash64(d, F.lit(depth)), F.lit(SPREAD)) == F.col("_part"))
            dealt = stuck.select(*key, "_l", "_r", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
            dealt = dealt.select(*key, of("_l").alias("_l"), of("_r").alias("_r"))
            met = self.compared(self.sketched(dealt, {"_l": "_a", "_r": "_b"}), "_a", "_b", "_d").drop("_a", "_b")
            # the arrays are stored with the pairs that are stuck alone
            met = met.withColumns({c: F.when(~F.col("_d.done"), F.col(c)) for c in ("_l", "_r")})
            met = self.space.keep(met, f"larger-{depth}")
            part = met.filter("_d.done").select(*key, "_d.gone", "_d.added")
            done = part if done is None else done.unionByName(part)
            stuck = met.filter("NOT _d.done").select(*key, "_l", "_r")
        whole = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731 - never more than a pair's paragraphs
        return done.groupBy(*key).agg(whole("gone"), whole("added"))


def compare_sets(
    rows: DataFrame, space: Workspace, key: list[str], base: str, others: list[str], sketches: list[str] | None = None
) -> DataFrame:
    """`rows` with the digest arrays `base` and `others` replaced by what their sketches tell.

    New columns: `<name>_size`, `<name>_sketch` (as text; for `sketches`, by default all) and
    `<other>_diff`, a struct of `gone` (digests of the base alone) and `added`. `key` is unique;
    arrays hold no digest twice, a null one counts as empty.
    """
    names, none = [base, *others], F.array().cast("array<bigint>")
    steps = Comparison(space, [*key, "_other"])
    met = steps.sketched(rows.withColumns({c: F.coalesce(F.col(c), none) for c in names}), {c: f"{c}_cells" for c in names})
    for c in others:
        met = steps.compared(met, f"{base}_cells", f"{c}_cells", f"{c}_diff")
    # arrays are stored with the pairs that are stuck alone
    pairs = F.filter(F.array(*[
        F.struct(F.lit(c).alias("_other"), F.col(base).alias("_l"), F.col(c).alias("_r"), F.col(f"{c}_diff.done").alias("done"))
        for c in others
    ]), lambda p: ~p["done"])
    met = met.withColumns(
        {f"{c}_sketch": shown(F.col(f"{c}_cells")) for c in (names if sketches is None else sketches)}
        | {f"{c}_size": F.size(c) for c in names} | {"_stuck": pairs}
    )
    met = space.keep(met.drop(*[f"{c}_cells" for c in names], *names), "compared")
    stuck = met.select(*key, F.inline("_stuck")).select(*key, "_other", "_l", "_r")
    found = steps.larger(stuck).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_other", F.struct("gone", "added")))).alias("_larger"))
    # rows without a stuck pair need no join
    settled = met.filter(F.size("_stuck") == 0).drop("_stuck").withColumn("_larger", F.lit(None).cast(found.schema["_larger"].dataType))
    met = settled.unionByName(met.filter(F.size("_stuck") > 0).drop("_stuck").join(found, key))
    for c in others:
        diff = F.col(f"{c}_diff")
        small = F.struct(diff["gone"].alias("gone"), diff["added"].alias("added"))
        met = met.withColumn(f"{c}_diff", F.when(diff["done"], small).otherwise(F.col("_larger")[c]))
    return met.drop("_larger")


def likeness(left: Column, right: Column, diff: Column) -> Column:
    """Jaccard index of two sets from their sizes and their difference; 1 if both are empty."""
    both, apart = left + right, F.size(diff["gone"]) + F.size(diff["added"])
    return F.when(both == 0, 1.0).otherwise((both - apart).cast("double") / (both + apart).cast("double"))


def fingerprint_edits(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id, gone, added.

    The edited text is the text with the last half of its code points, rounded down, replaced by as
    many from the start of the next text (or all it has); next is the row with the next smaller id,
    after the last the first. `near_` are Jaccard indices of the paragraphs; `gone` and `added` are the
    digests of the paragraphs that the edit removed and brought. Null text counts as empty; texts
    without a paragraph are alike (1). Paragraphs count once and without their order. A null id comes
    last; rows that repeat an id and a text are one document with several rows, those that repeat an
    id alone follow each other by a hash of the text. A single document is its own next. A line
    is a paragraph whatever its length; a sketch costs a text's paragraphs times the cells. Other
    columns are not read. An empty table gives no rows.
    """
    space = Workspace(df.sparkSession, "fingerprints")
    rows = df.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "key", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.base64(F.unhex(F.sha2("text", 256))))
    )
    # the order needs no texts: every document learns whose next it is
    known = rows.select("id", "key", F.length("text").alias("n")).groupBy("id", "key", "n").agg(F.count("*").alias("copies"))
    placed = numbered(known, [F.col("id").desc_nulls_last(), F.col("key")], space, "ordered")
    last = placed.agg(F.max("_pos")).first()[0]
    follows = F.when(F.col("_pos") == F.lit(last), F.lit(0)).otherwise(F.col("_pos") + 1)
    half = F.floor(F.col("n") / 2).cast("int")
    before = placed.select(follows.alias("_pos"), F.col("key").alias("before"), half.alias("wanted"))
    ordered = placed.join(before, "_pos").select("key", F.col("_pos").alias("pos"), "n", "copies", "before", "wanted")

    # one shuffle of whole texts: both uses of a text read it, as its columns are one that pruning does
    # not open; of a next text only what is wanted goes on
    whole = F.array(F.struct("pos", "id", "text", "n", "copies", "before", "wanted")).alias("row")
    texts = rows.select("key", "id", "text").join(ordered, "key").select("key", whole)
    number = F.row_number().over(W.partitionBy("key").orderBy("key"))
    single = texts.withColumn("_copy", number).filter("_copy = 1").select("key", F.col("row")[0].alias("row"))
    single = single.select("key", "row.*").withColumn("own", paragraph_digests(F.col("text")))
    nexts = single.select(
        F.col("before").alias("key"), F.col("id").alias("next_id"), F.left("text", F.col("wanted")).alias("start"), F.col("own").alias("following")
    )
    edited = single.join(nexts, "key").select(
        "pos", "id", "next_id", "n", "copies", "own", "following", F.concat(F.left("text", F.col("n") - half), "start").alias("edited")
    )
    sets = edited.withColumns({"changed": paragraph_digests(F.col("edited")), "edited_sha256": F.sha2("edited", 256)}).drop("edited")
    met = compare_sets(sets, space, ["pos"], "own", ["changed", "following"], ["own", "changed"])
    near = lambda c: likeness(F.col("own_size"), F.col(f"{c}_size"), F.col(f"{c}_diff"))
    result = met.select(
        "id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.col("own_sketch").alias("fingerprint"),
        F.col("changed_sketch").alias("edited_fingerprint"), near("changed").alias("near_edited"), near("following").alias("near_next"),
        "next_id", F.col("changed_diff.gone").alias("gone"), F.col("changed_diff.added").alias("added"), "copies",
    )
    return result.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_", "copies")
