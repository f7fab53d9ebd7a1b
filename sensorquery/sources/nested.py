"""Entity documents of any root, with everything nested in them, taken apart along the relation graph.

``members`` gives one row per entity of a document, at any depth and in both directions of every
relation: its table, its own properties as JSON, and which members its foreign keys point to. The
foreign keys follow from ``schema``: a relation to one sets the key of its holder, a relation to many
the key of the child, one over a link table makes a row of that table. Rules that need no stored data
are judged on the way, each member by its place (``reason``); times, results and geometries are judged
by the expressions that also read them (``value_reason``).

A member that carries ``@iot.id`` is a link and may carry nothing else. What is required of a member is
what its table requires (``not_null``), a relation given by the parent included; the parent's and an
own one at once are refused. Every thing that gets locations here also gets one visit (a historical
location) that is linked to all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.functions import geometry, values
from sensorquery.operators import identity
from sensorquery.session import scratch_path, ship_functions

EPSG = 4326
LINK_TABLES = ("thing_location", "location_historical_location")
_TEXTS = {"name", "description", "definition", "encodingType", "observationType", "phenomenonTime", "resultTime", "time", "validTime"}
# Properties that are read as they are, whatever JSON they hold.
_OBJECTS = {"unitOfMeasurement", "location", "feature", "observedArea"}

MEMBER = (
    "doc_id long, part int, nr long, seq int, table string, link_id long, existing boolean, path string, doc string, "
    "refs map<string,int>, reason string"
)


def _graph() -> dict[str, dict]:
    """What the walk needs of ``schema``, as plain data that travels to the executors."""
    out = {}
    for table, e in schema.ENTITIES.items():
        keys = {r.near: name for name, r in e.relations.items() if not r.many}
        out[table] = {
            "properties": set(e.properties), "relations": {
                name: (r.target, r.many, r.near, r.far, r.link, r.link_near, r.link_far) for name, r in e.relations.items()},
            # A visit may lack its time and a reading its time: both default to the time of the insert.
            "required": [n for n in e.not_null if n not in e.relations and (table, n) != ("historical_location", "time")],
            "keys": {near: name for near, name in keys.items() if name in e.not_null},
        }
    return out


class _Document:
    """The members of one document, in the order they are met: a child behind its parent."""

    def __init__(self, graph: dict, names: dict):
        self.graph, self.names = graph, names
        self.rows: list[dict] = []
        self.reason: str | None = None

    def fail(self, reason: str) -> None:
        self.reason = self.reason or reason

    def add(self, table: str, path: str, link=None, doc: dict | None = None) -> dict:
        row = {"seq": len(self.rows), "table": table, "link_id": link, "path": path, "doc": doc, "refs": {}}
        self.rows.append(row)
        return row

    def walk(self, table: str, found, path: str, given: str | None = None) -> dict | None:
        """``given``: the foreign key that the parent supplies."""
        spec = self.graph[table]
        if not isinstance(found, dict):
            return self.fail(f"not an object: {path.rstrip('.') or 'document'}")
        if "@iot.id" in found and path:
            link = found["@iot.id"]
            if len(found) > 1:
                return self.fail(f"more than an id: {path.rstrip('.')}")
            if isinstance(link, bool) or not isinstance(link, int) or abs(link) >= 1 << 63:
                return self.fail(f"id is not an integer: {path.rstrip('.')}")
            return self.add(table, path, link)
        unknown = sorted(k for k in found if k not in spec["properties"] and k not in spec["relations"] and k != "@iot.id")
        if unknown:
            self.fail("unknown: " + ",".join(path + k for k in unknown))
        missing = [k for k in spec["required"] if found.get(k) is None]
        missing += [n for near, n in spec["keys"].items() if n not in found and near != given]
        if missing:
            self.fail("missing: " + ",".join(path + k for k in missing))
        for k in spec["properties"] & found.keys():
            wrong = found[k] is not None and (
                k in _TEXTS and not isinstance(found[k], str) or k in _OBJECTS and not isinstance(found[k], dict))
            if wrong:
                self.fail(f"wrong type: {path}{k}")
        row = self.add(table, path, None, {k: v for k, v in found.items() if k in spec["properties"]})
        for name, (target, many, near, far, link, link_near, link_far) in spec["relations"].items():
            if name not in found:
                continue
            at, inner = f"{path}{name}.", found[name]
            if not many and near == given:
                self.fail(f"given by its parent: {path}{name}")
                continue
            if many and not isinstance(inner, list):
                self.fail(f"not a list: {path}{name}")
                continue
            if not many:
                child = self.walk(target, inner, at)
                if child:
                    row["refs"][near] = child["seq"]
                continue
            children = [c for c in (self.walk(target, x, at, None if link else far) for x in inner) if c]
            if link:
                for c in children:
                    self.add(link, at)["refs"].update({link_near: row["seq"], link_far: c["seq"]})
            else:
                for c in children:
                    c["refs"][far] = row["seq"]
        return row

    def visits(self) -> None:
        """One visit per thing that was linked to locations, linked to all of them."""
        places: dict[int, list[int]] = {}
        for row in self.rows:
            if row["table"] == "thing_location":
                places.setdefault(row["refs"]["thing_id"], []).append(row["refs"]["location_id"])
        for thing, held in places.items():
            visit = self.add("historical_location", self.rows[thing]["path"], None, {})
            visit["refs"]["thing_id"] = thing
            for place in held:
                link = self.add("location_historical_location", visit["path"])
                link["refs"].update({"location_id": place, "historical_location_id": visit["seq"]})


def _walk(graph: dict, names: dict[str, str]):
    """Documents (doc_id, nr, root, doc) of a task to member rows; ``nr`` tells equal ids apart."""

    def bad_number(text):
        raise ValueError(text)

    def taken_apart(doc_id, root, text) -> tuple[list[dict], str | None]:
        import json

        document = _Document(graph, names)
        table = names.get(root)
        if table is None:
            return [], f"unknown entity: {root}"
        try:
            found = json.loads(text or "", parse_constant=bad_number)
            document.walk(table, found, "")
            document.visits()
            for row in document.rows:
                if row["doc"] is not None:
                    row["doc"] = json.dumps(row["doc"], ensure_ascii=False)
                    row["doc"].encode()
        except (ValueError, RecursionError):  # no JSON, numbers or characters that JSON cannot hold, too deep
            return [], "not an object"
        return document.rows, document.reason

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema_ = pa.schema([
            ("doc_id", pa.int64()), ("part", pa.int32()), ("nr", pa.int64()), ("seq", pa.int32()), ("table", pa.string()),
            ("link_id", pa.int64()), ("existing", pa.bool_()), ("path", pa.string()), ("doc", pa.string()),
            ("refs", pa.map_(pa.string(), pa.int32())), ("reason", pa.string())])
        nr, out = 0, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "root", "doc")]
            for doc_id, root, text in zip(*columns):
                rows, reason = taken_apart(doc_id, root, text)
                head = {"doc_id": doc_id, "part": part, "nr": nr}
                nr += 1
                if reason:
                    out.append({**head, "seq": 0, "reason": reason})
                else:
                    out += [{**head, **r, "existing": r["link_id"] is not None, "refs": list(r["refs"].items())} for r in rows]
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema_)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema_)

    return run


def members(docs: DataFrame, root: str = "Thing") -> DataFrame:
    """Member rows of documents (doc_id, doc, and optionally ``entity``, the kind of each; else ``root``).

    Documents are put in order of their id by one range shuffle. The result is written, so that its
    parts and numbers stay what they are.
    """
    names = {n: e.table for e in schema.ENTITIES.values() for n in (e.table, e.collection, e.singular)}
    kind = F.col("entity") if "entity" in docs.columns else F.lit(root)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("root"), F.col("doc").cast("string").alias("doc"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("doc")).sortWithinPartitions("doc_id", "doc")
    return _written(ordered.mapInArrow(_walk(_graph(), names), MEMBER), "members")


def _written(df: DataFrame, label: str, *by: str) -> DataFrame:
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- values ----------------------------------------------------------------------------------


def _field(name: str) -> Column:
    return F.get_json_object("doc", f"$.{name}")


def _parsed(table: str) -> Column:
    """The own properties of a member, typed as they are read."""
    kinds = {"unitOfMeasurement": schema.UNIT, "metadata": "variant"} | dict.fromkeys(
        ("properties", "parameters", "result", "resultQuality", "location", "feature", "observedArea"), "variant")
    fields = ", ".join(f"`{p}`: {kinds.get(p, 'string')}" for p in schema.ENTITIES[table].properties)
    return F.from_json("doc", f"struct<{fields}>")


def _interval(name: str, start: str, end: str) -> dict[str, Column]:
    read = values.parse_time(F.col(f"p.{name}"))
    return {start: read.lower, end: read.upper}


def _columns(table: str) -> dict[str, Column]:
    """Table columns of a member's own properties (``p``)."""
    out: dict[str, Column] = {}
    for prop in schema.ENTITIES[table].properties:
        held, name = F.col(f"p.{prop}"), schema.column_name(prop)
        if (table, prop) in schema.INTERVALS:
            out |= _interval(prop, *schema.INTERVALS[table, prop][:2])
        elif prop in schema.GEOMETRY_PROPERTIES:
            out[name] = geometry.from_geojson(F.to_json(held))
        elif prop == "result":
            out |= values.typed_result(held)
        elif prop == "resultQuality":
            out[name] = F.try_variant_get(held, "$", "string")
        elif prop == "metadata":
            text = F.schema_of_variant(held) == "STRING"
            out[name] = F.when(text, F.try_variant_get(held, "$", "string")).otherwise(F.to_json(held))
        elif prop in ("properties", "parameters"):
            out[name] = F.to_json(held)
        elif prop in schema.TIME_PROPERTIES:
            out[name] = F.try_to_timestamp(held)
        else:
            out[name] = held
    return out


def value_reason() -> Column:
    """Why the values of a member cannot be stored: times, results, geometries, reference systems."""
    reason = F.lit(None).cast("string")
    at = lambda text, prop: F.concat(F.lit(f"{text}: "), "path", F.lit(prop))
    table = F.col("table")
    for name, e in schema.ENTITIES.items():
        for prop in e.properties:
            text = _field(prop)
            if (name, prop) in schema.INTERVALS:
                bad = text.isNotNull() & values.parse_time(text).lower.isNull()
                found = at("bad time", prop)
            elif prop in schema.TIME_PROPERTIES:
                bad, found = text.isNotNull() & F.try_to_timestamp(text).isNull(), at("bad time", prop)
            elif prop in schema.GEOMETRY_PROPERTIES:
                bad, found = text.isNotNull() & geometry.from_geojson(text).isNull(), at("not a geometry", prop)
                reason = F.coalesce(reason, F.when(
                    (table == name) & ~F.coalesce(geometry.crs_matches(text, EPSG), F.lit(False)) & text.isNotNull(),
                    at("other reference system", prop)))
            elif prop == "result":
                kind = values.typed_result(F.try_variant_get(F.try_parse_json("doc"), "$.result", "variant"))["result_type"]
                bad, found = kind.isNull(), at("result has no type", "result")
            else:
                continue
            reason = F.coalesce(reason, F.when((table == name) & F.col("doc").isNotNull() & bad, found))
    return reason


def judged(found: DataFrame) -> DataFrame:
    """(doc_id, part, nr, reason) of the documents that break a rule: the first in document order."""
    reasons = found.withColumn("reason", F.coalesce("reason", value_reason())).where("reason is not null")
    return reasons.groupBy("part", "nr").agg(
        F.first("doc_id").alias("doc_id"), F.min_by("reason", "seq").alias("reason"))


def unknown_links(found: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, part, nr, reason) of the documents that link to an id no table holds. Only the tables
    that are linked to are read, and of them the ids."""
    links = found.where("link_id is not null")
    used = sorted(r[0] for r in links.select("table").distinct().collect())  # at most one name per table
    wanted = links.select("table", "link_id").distinct()
    missing = wanted
    for t in used:
        ids = known[t].select(F.lit(t).alias("table"), F.col("id").alias("link_id")) if t in known else wanted.limit(0)
        # The ids linked to are few: they go to the stored ones, not the other way round.
        missing = missing.join(ids.join(wanted, ["table", "link_id"], "left_semi"), ["table", "link_id"], "left_anti")
    return links.join(missing, ["table", "link_id"]).groupBy("part", "nr").agg(
        F.first("doc_id").alias("doc_id"),
        F.min(F.struct("seq", F.concat(F.lit("unknown id: "), "path", F.col("link_id").cast("string")).alias("reason")))["reason"].alias("reason"))


# -- rows ------------------------------------------------------------------------------------


def rows_of(found: DataFrame, starts: dict[str, int]) -> dict[str, DataFrame]:
    """Row sets per table of member rows, new ones with ids from ``starts`` on, in document order.

    Ids of all tables come from one allocation, foreign keys from one join; both read the same written
    table. The key ``relinked`` holds the foreign keys that links got from their parents: (table, id,
    fk, target, and the order of the document).
    """
    fresh = found.where("link_id is null")
    ids = identity.allocate_ids(fresh, "table", "part", ["nr", "seq"], starts)
    numbered = _written(ids.unionByName(found.where("link_id is not null").withColumn("id", F.col("link_id"))), "numbered")
    key = ["part", "nr"]
    refs = numbered.select(*key, "seq", F.explode("refs").alias("fk", "target"))
    targets = numbered.select(*key, F.col("seq").alias("target"), F.col("id").alias("_target"), F.col("existing").alias("_old"))
    resolved = refs.join(targets, [*key, "target"]).groupBy(*key, "seq").agg(
        F.map_from_entries(F.collect_list(F.struct("fk", "_target"))).alias("fks"),
        F.map_from_entries(F.collect_list(F.struct("fk", "_old"))).alias("olds"))
    placed = _written(numbered.drop("refs", "reason", "path").join(resolved, [*key, "seq"], "left"), "placed", "table")

    def new(table: str) -> DataFrame:
        return placed.where((F.col("table") == table) & ~F.col("existing"))

    out = {}
    for table, entity in schema.ENTITIES.items():
        if table == "commit_log":
            continue
        own = _columns(table)
        keys = {r.near: F.col("fks")[r.near] for r in entity.relations.values() if not r.many}
        out[table] = new(table).withColumn("p", _parsed(table)).select("id", *[c.alias(n) for n, c in (own | keys).items()])
    for table in LINK_TABLES:
        names = schema.columns(table)
        # A thing that was there before moves: its old links end.
        old = [F.col("olds")["thing_id"].alias("moved")] if table == "thing_location" else []
        out[table] = new(table).select(*[F.col("fks")[n].alias(n) for n in names], *old).distinct()
    out["relinked"] = placed.where("existing and fks is not null").select(
        "table", "id", F.explode("fks").alias("fk", "target"), F.struct(*key, "seq").alias("order"))
    return out


ship_functions(__name__)
