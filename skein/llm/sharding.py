"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

A tree has regions, their racks, and these have shards; each node weighs what
its shards weigh together. A row descends from the root: at each level every
child draws -ln(u) / weight, where u in (0, 1) is a hash of the row's key and the
child's name, and the least draw wins, so that a child wins as often as its
share of the weight. A child's draw depends on nothing but its own name and
weight. Therefore a change moves rows only between the subtrees whose weights
change and their siblings, and what stays in a subtree stays where it is in there.

A shard that is added later is a region of its own: no other weight changes, and
so rows move into it and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Children of a region and of a rack in an even tree.
RACKS, RACK_SHARDS = 4, 5
#: Rows of a shard, all different, that are numbered by one task.
PART_ROWS = 200_000
#: Copies of one row that are numbered by one task.
COPIES = 100_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Tree:
    """Weights of shards: regions of racks of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int, racks: int = RACKS, rack_shards: int = RACK_SHARDS) -> Tree:
        """Shards 0, 1, ... of weight 1, in racks and regions filled in order."""
        filled = [tuple((k, 1.0) for k in range(s, min(shards, s + rack_shards))) for s in range(0, shards, rack_shards)]
        return Tree(tuple(tuple(filled[k : k + racks]) for k in range(0, len(filled), racks)))

    def shards(self) -> dict[int, float]:
        return {s: w for region in self.regions for rack in region for s, w in rack}

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own, that takes rows only into itself."""
        return Tree((*self.regions, (((max(self.shards(), default=-1) + 1, weight),),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        """With another weight of one shard, and so of its rack and region; 0 empties it."""
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    def place(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows and, as column `name`, the shard of each one's key (a string); three levels of draws.

        A column is made of each level's choice before the next level reads it, so
        that a row draws for the children of its own region and rack alone. None is
        null, and says so, for joins would repeat all of it to look for nulls.
        """
        if not any(w > 0 for w in self.shards().values()):
            raise ValueError("a tree needs a shard with weight")
        racks = [[sum(w for _, w in rack) for rack in region] for region in self.regions]
        widest = [max(map(len, racks)), max(len(rack) for region in self.regions for rack in region)]
        of_region = f"get({_table(racks, 'double')}, __g)"
        shards, weights = (f"get(get({_table([[[leaf[n] for leaf in rack] for rack in region] for region in self.regions], kind)}, __g), __r)" for n, kind in ((0, "int"), (1, "double")))
        leaves = [f"get({shards}, {k})" for k in range(widest[1])]
        placed = rows.withColumn("__key", key)
        placed = placed.withColumn("__g", _first([(_draw(f"'g{k}'", f"{float(sum(own))}D"), k) for k, own in enumerate(racks)]))
        placed = placed.withColumn("__r", _first([(_draw(f"concat('r', __g, '.{k}')", f"get({of_region}, {k})"), k) for k in range(widest[0])]))
        placed = placed.withColumn(name, _first([(_draw(f"concat('s', {own})", f"get({weights}, {k})"), own) for k, own in enumerate(leaves)]))
        return placed.drop("__key", "__g", "__r")


def _table(nested, kind: str) -> str:
    """A nested list of numbers as a constant."""
    return f"array({', '.join(_table(x, kind) for x in nested)})" if isinstance(nested, list) else f"cast({nested} as {kind})"


def _draw(name: str, weight: str) -> str:
    """-ln(u) / weight, u from 52 bits of a hash of key and name; infinite without a weight."""
    return f"if({weight} > 0, -ln((cast(conv(substring(md5(concat(__key, '@', {name})), 1, 13), 16, 10) as double) + 0.5) / 4503599627370496D) / {weight}, double('infinity'))"


def _first(children: list[tuple[str, int | str]]) -> Column:
    """What the child with the least draw is, the first of equal ones."""
    drawn = ", ".join(f"struct({draw} as draw, {k} as k, {own} as own)" for k, (draw, own) in enumerate(children))
    return F.expr(f"coalesce(array_min(array({drawn})).own, 0)")


def key_of(doc_id: Column) -> Column:
    """The key of an id; a null one is the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def assign(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", name: str = "shard") -> DataFrame:
    """All columns of docs and the shard of each row (a column of that name is replaced).

    No shuffle: the id and the tree decide. Rows of one id are together; a null id is that of
    the empty text; an empty table gives an empty result.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    placed = tree.place(plain, key_of(F.col(f"c{docs.columns.index(doc_id)}")), "__shard")
    keep = [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns) if n.lower() != name.lower()]
    return placed.select(*keep, F.col("__shard").alias(name))


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """rows (doc_id, size, text_crc32, shard and others that follow from them) plus slot: from 0
    without gaps in each shard, in the order of a hash of the row.

    Equal rows are counted before anything is shuffled by shard, a shard's rows
    are numbered in parts of one range of the hash each, and what parts and copies
    begin with is a running sum of counts: no task sees a whole shard, and none
    more than COPIES copies of a row.
    """
    parts = max(1, -(-total // PART_ROWS))
    place = F.conv(F.substring(F.md5(F.concat_ws("#", key_of(F.col("doc_id")), "size", "text_crc32")), 1, 12), 16, 10).cast("long")
    kinds = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("place", place)
    kinds = kinds.withColumn("part", F.coalesce(F.floor(F.col("place") * F.lit(parts / 2.0**48)).cast("int"), F.lit(0)))
    own, before = Window.partitionBy("shard", "part"), (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("copies").over(own.orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(*before)), F.lit(0))
    sums = kinds.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(*before)), F.lit(0))
    begun = sums.select("shard", "part", ahead.alias("ahead"))
    first = kinds.withColumn("inside", inside).join(begun, ["shard", "part"]).withColumn("first", F.col("ahead") + F.col("inside"))
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int")))
    runs = first.select(*rows.columns, "copies", "first", run.alias("run")).repartition("shard", "first", "run")
    left = F.least(F.col("copies") - F.col("run") * F.lit(COPIES).cast("long"), F.lit(COPIES).cast("long"))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), left - 1))
    dealt = runs.select(*rows.columns, "first", "run", copy.alias("copy"))
    return dealt.select(*rows.columns, (F.col("first") + F.col("run") * F.lit(COPIES).cast("long") + F.col("copy")).alias("slot"))


def shard_documents(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Every row of docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the tree (40 even shards, unless given) decide,
    and grown_shard, the shard in the tree with one more, is shard or the new
    one. A null text counts as empty (size 16, crc 0), a null id as the empty
    text; rows of one id are in one shard; repeated rows have a slot each; very
    long texts are read once for size and crc and not moved; an empty table gives an empty result;
    other columns are ignored.
    """
    tree = Tree.even(40) if tree is None else tree
    body, key = F.coalesce("text", F.lit("")), key_of(F.col("doc_id"))
    sized = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = tree.grown().place(tree.place(sized, key, "shard"), key, "grown_shard")
    return numbered(rows, docs.count()).withColumn("law", F.lit("key"))


def write_shards(docs: DataFrame, path: str, tree: Tree, files: int = 8) -> None:
    """Write docs with their shard as Parquet below path, a folder for each shard and about `files`
    files in each: rows are dealt by shard and a hash of id and text, so that no task has a
    whole shard, whatever repeats."""
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    assign(docs, tree).repartition("shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)


def _draw_sql(name: str, weight: float) -> str:
    return f"-ln((cast(cast('0x' || md5(key || '@{name}')[1:13] as bigint) as double) + 0.5) / 4503599627370496::double) / {float(weight)}::double"


def _descend_sql(children: list[tuple[str, float, str]]) -> str:
    if len(children) == 1:
        return children[0][2]
    drawn = "[" + ", ".join(_draw_sql(name, w) for name, w, _ in children) + "]"
    return f"(case list_position({drawn}, list_min({drawn})) " + " ".join(f"when {k} then {what}" for k, (_, _, what) in enumerate(children, 1)) + " end)"


def _shard_sql(tree: Tree) -> str:
    racks = lambda g, region: [(f"r{g}.{r}", sum(w for _, w in rack), _descend_sql([(f"s{s}", w, str(s)) for s, w in rack])) for r, rack in enumerate(region)]
    return _descend_sql([(f"g{g}", sum(w for rack in region for _, w in rack), _descend_sql(racks(g, region))) for g, region in enumerate(tree.regions)])


#: CRC-32 of the bytes of body, with steps, a list made from the polynomial.
_CRC_SQL = """xor(4294967295::bigint, list_reduce(list_transform(regexp_extract_all(hex(body), '..'), lambda x: cast('0x' || x as bigint)),
 lambda acc, b: xor(acc >> 8, steps[cast(xor(acc & 255, b) + 1 as int)]), 4294967295::bigint))"""
_STEP_SQL = "case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end"

SHARD_SQL = f"""with recursive bits as (select i, cast(i as bigint) as c, 0 as k from range(256) t(i) union all select i, {_STEP_SQL}, k + 1 from bits where k < 8),
crc as (select list(c order by i) as steps from bits where k = 8),
bodies as (select doc_id, coalesce(cast(doc_id as varchar), '') as key, coalesce(text, '') as body from documents),
sized as (select doc_id, key, cast(strlen(body) + {ROW_BYTES} as bigint) as size, cast({_CRC_SQL} as bigint) as text_crc32 from bodies, crc),
placed as (select doc_id, size, text_crc32, {_shard_sql(Tree.even(40))} as shard, {_shard_sql(Tree.even(40).grown())} as grown_shard,
 cast('0x' || md5(key || '#' || size || '#' || text_crc32)[1:12] as bigint) as place from sized)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard, row_number() over (partition by shard order by place, doc_id, size, text_crc32) - 1 as slot from placed"""
