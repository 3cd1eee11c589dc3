"""Deeply nested XML records into related flat tables.

Each record is stream-parsed once into (path, ordinal, value) triples of the nodes that matter; triples of one repeated
ancestor share its node number, so a group's triples pivot into one row of the group's table. Parent-child links are node
numbers, unique within a record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.session import cut

TRIPLES = "node_no int, parent_no int, grp string, tag string, path string, ordinal int, value string"
MALFORMED = "malformed"


@dataclass(frozen=True)
class Group:
    """One repeated ancestor. `parents`: the groups (or '' for the anchor element) it may hang below; `tag`: its element
    name, '*' for any that no other group of the same parent claims."""

    name: str
    parents: tuple[str, ...]
    tag: str


#: slots, devices and memory ranges of a machine description
MACHINE_GROUPS = (
    Group("primary", ("",), "primary"),
    Group("secondary", ("primary",), "secondary"),
    Group("device", ("primary", "secondary"), "*"),
    Group("range", ("device",), "mem"),
)


#: columns of the tables of machine descriptions
MACHINE_PATHS = {
    ("primary", "secondary"): {"slot": "@slot", "external": "@external"},
    "device": {"device_id": "@id", "size": "size/#", "mapper_type": "mappertype/#", "sram_size": "sramsize/#", "first_sha1": "rom/sha1/#", "visible_base": "rom_visibility/@base", "visible_size": "rom_visibility/@size"},
    "range": {"base": "@base", "size": "@size"},
}


class _Shredder:
    """Expat handlers that keep only a stack of open elements, never the tree."""

    def __init__(self, anchor: tuple[str, ...], groups: tuple[Group, ...], text: bool):
        self.anchor, self.text = anchor, text
        self.exact = {(p, g.tag): g.name for g in groups for p in g.parents if g.tag != "*"}
        self.other = {p: g.name for g in groups for p in g.parents if g.tag == "*"}
        self.out: list[tuple] = []
        #: per open element: (group or None, node number of the nearest group node, path below it, child ordinals, text parts)
        self.stack: list[list] = []
        self.names: list[str] = []
        self.count = 0

    def start(self, tag: str, attrs: list[str]) -> None:
        depth = len(self.names)
        self.names.append(tag)
        if depth < len(self.anchor):
            ok = (depth == 0 or self.stack[-1] is not None) and self.anchor[depth] in ("*", tag)
            self.stack.append(["" if depth + 1 == len(self.anchor) else None, 0, "", {}, []] if ok else None)
            return
        top = self.stack[-1]
        if top is None:
            self.stack.append(None)
            return
        group, node, path, seen, _ = top
        name = None if group is None else self.exact.get((group, tag)) or self.other.get(group)
        if group == "" and name is None:
            self.stack.append(None)
            return
        if name:
            self.count += 1
            self.out.append((self.count, node, name, tag, "", 0, None))
            for i in range(0, len(attrs), 2):
                self.out.append((self.count, node, name, tag, "@" + attrs[i], 0, attrs[i + 1]))
            self.stack.append([name, self.count, "", {}, []])
            return
        n = seen[tag] = seen.get(tag, 0) + 1
        at = f"{path}/{tag}" if path else tag
        if self.text:
            for i in range(0, len(attrs), 2):
                self.out.append((node, -1, "", "", f"{at}/@{attrs[i]}", n, attrs[i + 1]))
        self.stack.append([None, node, at, {}, []])

    def end(self, tag: str) -> None:
        self.names.pop()
        top = self.stack.pop()
        if self.text and top and top[1] and (value := "".join(top[4]).strip()):
            self.out.append((top[1], -1, "", "", f"{top[2]}/#" if top[2] else "#", 1, value))

    def chars(self, data: str) -> None:
        if self.text and self.stack and self.stack[-1]:
            self.stack[-1][4].append(data)


def shred_one(xml: str | None, anchor: tuple[str, ...], groups: tuple[Group, ...], text: bool) -> list[tuple]:
    """Triples of one record; a null or not well-formed record gives the single node 0 of group 'malformed'."""
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True
    parser.buffer_text = True
    s = _Shredder(anchor, groups, text)
    parser.StartElementHandler, parser.EndElementHandler = s.start, s.end
    if text:
        parser.CharacterDataHandler = s.chars
    try:
        if xml is None:
            raise expat.ExpatError("null record")
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, UnicodeError):
        return [(0, -1, MALFORMED, MALFORMED, "", 0, None)]
    return s.out


def shred(df: DataFrame, id_col: str, xml_col: str, *, anchor: tuple[str, ...] = ("*", "devices"), groups: tuple[Group, ...] = MACHINE_GROUPS, text: bool = True) -> DataFrame:
    """Triples of every record: (id, node_no, parent_no, grp, tag, path, ordinal, value).

    Every group node has one triple with path '' that carries its parent, group and tag. `text=False` leaves out the
    content below group nodes (only their own attributes are kept), which shortens the exchange where only links matter.
    Records are independent: no record needs more memory than its own open elements and triples.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = [], [[] for _ in range(7)]
            for rid, xml in zip(batch.column(0), batch.column(1), strict=True):
                rows = shred_one(xml.as_py(), anchor, groups, text)
                ids += [rid.as_py()] * len(rows)
                for k, c in enumerate(zip(*rows, strict=True)):
                    cols[k] += c
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "node_no", "parent_no", "grp", "tag", "path", "ordinal", "value"])

    return df.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml")).mapInArrow(run, f"id {id_type}, {TRIPLES}").withColumnRenamed("id", id_col)


def pivot_group(triples: DataFrame, id_col: str, group: str | tuple[str, ...], paths: dict[str, str]) -> DataFrame:
    """The flat table of one group (or of several of one shape): one row per node, one column per wanted path.

    `paths`: column -> path below the node ('@slot', 'size/#', ...). A path met several times gives its first value.
    """
    groups = (group,) if isinstance(group, str) else group
    own = triples.where(F.col("path").isin("", *paths.values()))
    first = [F.min_by("value", F.when(F.col("path") == p, F.col("ordinal"))).alias(c) for c, p in paths.items()]
    head = [F.max(F.when(F.col("path") == "", F.col(c))).alias(c) for c in ("parent_no", "grp", "tag")]
    return own.groupBy(id_col, "node_no").agg(*head, *first).where(F.col("grp").isin(*groups))


def repeated_paths(df: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """Which element paths repeat below one parent in any record: (path, max_siblings, records). The paths with
    max_siblings > 1 are the natural groups of a schema that is not known beforehand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[str, list[int]] = {}
            for xml in batch.column(1):
                own: dict[str, int] = {}
                stack: list[tuple[str, dict]] = [("", {})]

                def start(tag: str, attrs: list[str], stack=stack, own=own) -> None:
                    path, seen = stack[-1]
                    seen[tag] = seen.get(tag, 0) + 1
                    at = f"{path}/{tag}"
                    own[at] = max(own.get(at, 0), seen[tag])
                    stack.append((at, {}))

                parser = expat.ParserCreate("utf-8")
                parser.ordered_attributes = True
                parser.StartElementHandler = start
                parser.EndElementHandler = lambda tag, stack=stack: stack.pop()
                try:
                    parser.Parse((xml.as_py() or "").encode("utf-8", "surrogatepass"), True)
                except expat.ExpatError:
                    continue
                for at, n in own.items():
                    b = best.setdefault(at, [0, 0])
                    b[0], b[1] = max(b[0], n), b[1] + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([b[0] for b in best.values()], pa.int32()), pa.array([b[1] for b in best.values()], pa.int64())], names=["path", "n", "records"])

    found = df.select(F.col(id_col), F.col(xml_col)).mapInArrow(run, "path string, n int, records long")
    return found.groupBy("path").agg(F.max("n").alias("max_siblings"), F.sum("records").alias("records"))


def machine_nodes(df: DataFrame, id_col: str = "xml_id", xml_col: str = "xml_text") -> DataFrame:
    """All slots, devices and ranges of machine descriptions as one table of linked nodes.

    Null and broken documents give one row with node 0; documents without slots give none; documents sent twice under the
    same id give the same rows once per id.
    """
    t = shred(df, id_col, xml_col, text=False)
    nodes = pivot_group(t, id_col, ("primary", "secondary", "device", "range", MALFORMED), {"slot": "@slot", "external": "@external"})
    is_slot = F.col("grp").isin("primary", "secondary")
    slot = F.regexp_replace("slot", r"(?U)^\s+|\s+$", "")
    number = F.when(is_slot & slot.rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(regexp_replace(slot, '[^0-9+-]', '') as int)"))
    return nodes.select(
        id_col, "node_no", "parent_no", "tag",
        F.coalesce(number, F.lit(-1)).cast("int").alias("slot_no"),
        F.when(is_slot & (F.col("external") == "true"), 1).otherwise(0).cast("int").alias("is_external"),
    )


def machine_tables(df: DataFrame, id_col: str = "xml_id", xml_col: str = "xml_text") -> dict[str, DataFrame]:
    """The related flat tables: slots, devices, ranges; each row has node_no and parent_no within its document. Documents are
    parsed once, whatever is read of the tables."""
    t = cut(shred(df, id_col, xml_col).where(F.col("path").isin("", *{p for g in MACHINE_PATHS.values() for p in g.values()})))
    slots, devices, ranges = (pivot_group(t, id_col, g, MACHINE_PATHS[g]) for g in (("primary", "secondary"), "device", "range"))
    return {"slots": slots, "devices": devices, "ranges": ranges}


class _PathShredder:
    """Expat handlers for groups that are known by their element paths: every repeated element is a node, what stands below it
    belongs to it up to the next repeated one."""

    def __init__(self, groups: frozenset[str]):
        self.groups = groups
        self.out: list[tuple] = [(0, -1, "", "", 0, None)]
        #: per open element: (absolute path, node, parent node, group, path below the node, child ordinals, text parts)
        self.stack: list[tuple] = [("", 0, -1, "", "", {}, [])]
        self.count = 0

    def start(self, tag: str, attrs: list[str]) -> None:
        at, node, parent, group, below, seen, _ = self.stack[-1]
        path = f"{at}/{tag}"
        n = seen[tag] = seen.get(tag, 0) + 1
        if path in self.groups:
            self.count += 1
            node, parent, group, below = self.count, node, path, ""
            self.out.append((node, parent, group, "", n, None))
        else:
            below = f"{below}/{tag}" if below else tag
        for i in range(0, len(attrs), 2):
            self.out.append((node, parent, group, f"{below}/@{attrs[i]}" if below else f"@{attrs[i]}", n, attrs[i + 1]))
        self.stack.append((path, node, parent, group, below, {}, []))

    def end(self, tag: str) -> None:
        _, node, parent, group, below, _, text = self.stack.pop()
        if value := "".join(text).strip():
            self.out.append((node, parent, group, f"{below}/#" if below else "#", 1, value))

    def chars(self, data: str) -> None:
        self.stack[-1][6].append(data)


def shred_paths(df: DataFrame, id_col: str, xml_col: str, groups: list[str]) -> DataFrame:
    """Triples of every well-formed record: (id, node_no, parent_no, grp, path, ordinal, value), grouped by the nearest ancestor whose
    path is one of `groups`; what has none belongs to node 0, the record. Null and broken records give one row of group
    'malformed'."""
    id_type, known = df.schema[id_col].dataType.simpleString(), frozenset(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = [], [[] for _ in range(6)]
            for rid, xml in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parser, s = expat.ParserCreate("utf-8"), _PathShredder(known)
                parser.ordered_attributes = parser.buffer_text = True
                parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = s.start, s.end, s.chars
                try:
                    parser.Parse((xml.as_py() or "").encode("utf-8", "surrogatepass"), True)
                    rows = s.out
                except (expat.ExpatError, UnicodeError):
                    rows = [(0, -1, MALFORMED, "", 0, None)]
                ids += [rid] * len(rows)
                for k, c in enumerate(zip(*rows, strict=True)):
                    cols[k] += c
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "node_no", "parent_no", "grp", "path", "ordinal", "value"])

    schema = f"id {id_type}, node_no int, parent_no int, grp string, path string, ordinal int, value string"
    return df.select(F.col(id_col).alias("id"), F.col(xml_col).cast("string").alias("xml")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def discovered_tables(df: DataFrame, id_col: str, xml_col: str, limit: int = 1000) -> dict[str, DataFrame]:
    """One flat table per repeated ancestor path of records whose schema is not known beforehand; '' is the records themselves.

    Rows are (id, node_no, parent_no, one column per path below the node that holds a value); parent_no is the node of the
    enclosing repeated element. A path met several times below one node gives its first value. Only paths reach the driver:
    ValueError beyond `limit` of them.
    """
    repeated = [r.path for r in repeated_paths(df, id_col, xml_col).where("max_siblings > 1").limit(limit + 1).collect()]
    triples = cut(shred_paths(df, id_col, xml_col, repeated))
    held = triples.where("path <> '' and value is not null").select("grp", "path").distinct().limit(limit + 1).collect()
    if max(len(repeated), len(held)) > limit:
        raise ValueError(f"more than {limit} paths")
    out = {}
    for g in ["", *sorted(repeated)]:
        paths = sorted(r.path for r in held if r.grp == g)
        first = [F.min_by("value", F.when(F.col("path") == p, F.col("ordinal"))).alias(p) for p in paths]
        out[g] = triples.where(F.col("grp") == g).groupBy(id_col, "node_no").agg(F.max("parent_no").alias("parent_no"), *first)
    return out
