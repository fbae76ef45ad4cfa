"""Nested semi-structured records as flat tables that keep the link from child to parent.

A record holds a tree as JSON text. Objects with a title or a node_id are nodes; lists, JSON kept inside
strings, and objects with neither are wrapping, and what they hold belongs to the node above. Everything is
one projection of higher-order functions: nested transforms carry the ancestors' keys and positions, flatten
joins the arrays, and one inline per target table emits the rows. No level is capped: the deepest
nesting of brackets in the data sets the number of steps.

Null, empty or unreadable text, also inside an encoded part, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<title:string,node_id:string,text:string,penjelasan:string,navigation_path:string,start_index:string,relasi:string,nodes:string>"
LEVEL = f"array<struct<ord_path:string,parent_path:string,node:{NODE}>>"
ITEM = f"struct<is_node:boolean,raw:string,node:{NODE}>"


def _nesting(raw: Column) -> Column:
    """At least how deep the brackets in raw nest, those in encoded parts and quoted layers included.

    Brackets inside plain texts can only add to it: the depth is taken from the lowest balance before, and
    closing brackets too many are added once more.
    """

    def walk(s: Column, b: Column) -> Column:
        now = s["now"] + F.when((b == "[") | (b == "{"), 1).otherwise(-1)
        return F.struct(
            now.alias("now"), F.least(s["least"], now).alias("least"), F.greatest(s["most"], now - s["least"]).alias("most")
        )

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("least"), F.lit(1).alias("most"))
    found = F.aggregate(F.regexp_extract_all(raw, F.lit(r"[\[\]{}]"), F.lit(0)), start, walk)
    return _let(found, lambda f: f["most"] + F.abs(f["now"]) + F.length(F.regexp_extract(raw, '^[" \\\\]*', 0)) + 1)


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once: lambdas share no common subexpressions."""
    return F.transform(F.array(value), use)[0]


def _as_items(raws: Column) -> Column:
    """Raw JSON values as items, told apart into nodes and wrapping; null and empty values are left out."""

    def item(raw: Column) -> Column:
        return _let(
            F.when(raw.startswith("{"), F.from_json(raw, NODE)),
            lambda node: F.struct(
                F.coalesce(_filled(node["title"]) | _filled(node["node_id"]), F.lit(False)).alias("is_node"),
                raw.alias("raw"),
                node.alias("node"),
            ),
        )

    def holds(raw: Column) -> Column:
        return F.coalesce(raw.startswith("{") | raw.startswith("[") | raw.startswith('"'), F.lit(False))

    bare = F.transform(raws, lambda x: F.ltrim(x, F.lit(" \t\r\n\ufeff")))
    return F.transform(F.filter(bare, holds), item)


def _held(item: Column) -> Column:
    """The raw values that a list, an encoded text or a wrapping object holds, in reading order; null if it can't be read."""
    raw = item["raw"]
    return (
        F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
        .when(raw.startswith('"'), F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"))
        .otherwise(F.map_values(F.from_json(raw, "map<string,string>")))
    )


def _unwrapped(raw: Column) -> Column:
    """The nodes that a raw value holds directly, in reading order; null if a part can't be read."""
    state = "struct<open:boolean,items:array<" + ITEM + ">>"

    def pack(items: Column) -> Column:
        return _let(
            items,
            lambda x: F.struct(F.coalesce(F.exists(x, lambda i: ~i["is_node"]), F.lit(False)).alias("open"), x.alias("items")),
        ).cast(state)

    def step(s: Column, _: Column) -> Column:
        opened = F.flatten(F.transform(s["items"], lambda i: F.when(i["is_node"], F.array(i)).otherwise(_as_items(_held(i)))))
        return F.when(s["open"], pack(opened)).otherwise(s)

    # the depth is only looked for where two layers were not enough
    two = F.aggregate(F.sequence(F.lit(1), F.lit(2)), pack(_as_items(F.array(raw))), step)
    none = F.array().cast("array<int>")
    return _let(two, lambda s: F.aggregate(F.when(s["open"], F.sequence(F.lit(1), _nesting(raw))).otherwise(none), s, step)["items"])


def _children(path: Column, held: Column) -> Column:
    """The nodes directly in held, with their own path and that of their parent."""

    def child(item: Column, i: Column) -> Column:
        at = (i + 1).cast("string")
        return F.struct(
            F.when(path == "", at).otherwise(F.concat_ws(".", path, at)).alias("ord_path"),
            path.alias("parent_path"),
            item["node"].alias("node"),
        )

    return F.transform(_unwrapped(held), child)


def _below(level: Column) -> Column:
    """The nodes of the next level, in order; null if a part can't be read."""
    with_nodes = F.filter(level, lambda n: _filled(n["node"]["nodes"]))
    return F.flatten(F.transform(with_nodes, lambda n: _children(n["ord_path"], n["node"]["nodes"])))


def _levels(raw: Column) -> Column:
    """All levels of the tree in raw, an array of nodes per depth; null if a part can't be read."""
    state = f"struct<now:{LEVEL},levels:array<{LEVEL}>>"

    def deeper(s: Column, _: Column) -> Column:
        grown = _let(_below(s["now"]), lambda b: F.struct(b.alias("now"), F.concat(s["levels"], F.array(b)).alias("levels")))
        # an unreadable part makes now null, which ends the steps and leaves a null among the levels
        return F.when(F.size(s["now"]) > 0, grown.cast(state)).otherwise(s)

    start = _let(_children(F.lit(""), raw), lambda t: F.struct(t.alias("now"), F.array(t).alias("levels"))).cast(state)
    return F.aggregate(F.sequence(F.lit(1), _nesting(raw)), start, deeper)["levels"]


def explode_levels(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, nodes): the flat array of a record's nodes, null for a record that can't be read in full.

    key and json name columns of docs; other columns don't matter. Repeated rows give repeated results.
    """
    text = F.ltrim(F.col(json), F.lit(" \t\r\n\ufeff"))
    readable = docs.select(F.col(key).alias("__key"), text.alias("__raw")).where(
        F.coalesce(F.try_parse_json("__raw").isNotNull(), F.lit(False))
    )
    # flatten over an array that holds a null is null: one unreadable part drops the record
    return readable.select(F.col("__key").alias(key), F.flatten(_levels(F.col("__raw"))).alias("nodes"))


def node_table(docs: DataFrame, key: str = "raw_id", json: str = "structure") -> DataFrame:
    """One row per node: key, ord_path, parent_path, node_id, title, text, penjelasan, start_index.

    ord_path counts from 1 among the nodes with the same parent, in reading order; parent_path is '' at the top.
    node_id is '' where missing or null; start_index is null where it is no whole number.
    """
    rows = explode_levels(docs, key, json).select(key, F.inline("nodes"))
    return rows.select(
        key,
        "ord_path",
        "parent_path",
        F.coalesce("node.node_id", F.lit("")).alias("node_id"),
        F.coalesce("node.title", F.lit("")).alias("title"),
        F.col("node.text").alias("text"),
        F.col("node.penjelasan").alias("penjelasan"),
        F.col("node.start_index").try_cast("int").alias("start_index"),
    )


def relation_table(docs: DataFrame, key: str = "raw_id", json: str = "structure") -> DataFrame:
    """One row per entry of a node's relasi: key, ord_path of its node, rel_no from 1, tipe_relasi, ref_display.

    A single object in place of a list counts as a list of one; empty entries don't count.
    """
    fields = "array<struct<tipe_relasi:string,ref_display:string>>"

    def entries(n: Column) -> Column:
        raw = F.trim(n["node"]["relasi"])
        as_list = F.when(raw.startswith("["), raw).when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]")))
        found = F.filter(F.from_json(as_list, fields), lambda r: r.isNotNull())
        return F.transform(
            F.coalesce(found, F.array().cast(fields)),
            lambda r, i: F.struct(
                n["ord_path"].alias("ord_path"),
                (i + 1).alias("rel_no"),
                r["tipe_relasi"].alias("tipe_relasi"),
                r["ref_display"].alias("ref_display"),
            ),
        )

    rows = explode_levels(docs, key, json)
    return rows.select(key, F.inline(F.flatten(F.transform("nodes", entries))))


def navigation_table(docs: DataFrame, key: str = "raw_id", json: str = "structure") -> DataFrame:
    """One row per step of a node's navigation_path: key, ord_path of its node, step_no from 1, label.

    The path may be a text with ' > ' between the steps or a list; null and empty ones give no rows.
    """

    def steps(n: Column) -> Column:
        raw = F.trim(n["node"]["navigation_path"])
        parts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw != "", F.split(raw, r"\s*>\s*"))
        return F.transform(
            F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: _filled(p)),
            lambda p, i: F.struct(n["ord_path"].alias("ord_path"), (i + 1).alias("step_no"), F.trim(p).alias("label")),
        )

    rows = explode_levels(docs, key, json)
    return rows.select(key, F.inline(F.flatten(F.transform("nodes", steps))))
