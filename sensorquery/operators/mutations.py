"""Changes to the tables: validate, patch, replace, relink, delete, and the rows they derive."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.catalog import Catalog, chunk_start
from sensorquery.operators import identity, maintain
from sensorquery.operators.query import Predicate, filter_rows
from sensorquery.session import materialize, ship_functions

ship_functions(__name__)

# -- validation ------------------------------------------------------------------------------


def validate(docs: DataFrame, name: str, action: str = "create") -> DataFrame:
    """JSON documents (column ``doc``) with a ``reason``: null if the document is acceptable.

    Checks, in this order: a JSON object, known keys only, required keys present, relations given
    as objects, and integer ids in them.
    """
    entity = schema.entity(name)
    required = entity.create if action == "create" else entity.replace
    allowed = ["@iot.id", *entity.properties, *entity.relations]
    doc = F.col("doc")
    keys = F.json_object_keys(doc)
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    reason = F.when(keys.isNull(), "not an object").when(
        F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ","))
    ).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    for relation, target in entity.relations.items():
        if target.many:
            continue
        value = F.get_json_object(doc, f"$.{relation}")
        key = F.get_json_object(doc, f"$['{relation}']['@iot.id']")
        reason = reason.when(value.isNotNull() & ~value.startswith("{"), f"not an object: {relation}")
        kind = F.schema_of_variant(
            F.try_variant_get(F.try_parse_json(value), "$['@iot.id']", "variant")
        )
        reason = reason.when(
            key.isNotNull() & (kind != "BIGINT"), f"id is not an integer: {relation}"
        )
    return docs.withColumn("reason", reason)


def split_valid(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their reason)."""
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(
        F.col("reason").isNotNull()
    )


def link_relations(docs: DataFrame, relation: str) -> DataFrame:
    """Adds ``existing_id`` (link to a stored row) and ``inline`` (document to create)."""
    value = F.get_json_object("doc", f"$.{relation}")
    key = F.get_json_object("doc", f"$['{relation}']['@iot.id']").try_cast("bigint")
    return docs.withColumn("existing_id", key).withColumn(
        "inline", F.when(key.isNull() & value.isNotNull(), value)
    )


# -- patch and replace -----------------------------------------------------------------------


def patch(table: str, rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge patch: only the columns named in ``present`` change; one change row per id."""
    own = [c for c in changes.columns if c not in ("id", "present") and c in rows.columns]
    news = changes.select("id", "present", *[F.col(c).alias(f"_new_{c}") for c in own])
    joined = rows.join(news, "id", "left")

    def given(c: str) -> Column:
        return F.coalesce(F.array_contains("present", c), F.lit(False))

    columns = {c: F.when(given(c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in own}
    if table == "location" and "gen_foi_id" in rows.columns and "location" in own:
        # The generated feature no longer describes the moved location.
        columns["gen_foi_id"] = F.when(~given("location"), F.col("gen_foi_id"))
    patched = joined.withColumns(columns)
    if table == "observation" and "chunk" in rows.columns:
        # A reading whose time moved also moves to another chunk.
        patched = patched.withColumn("chunk", chunk_start(F.col("phenomenon_start")))
    return patched.select(*rows.columns)


def moved_chunks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Chunks to rewrite after a patch that moved readings in time."""
    old = before.select("id", F.col("chunk").alias("_old"))
    moved = after.select("id", F.col("chunk").alias("_new")).join(old, "id").where(
        F.col("_old") != F.col("_new")
    )
    return moved.select(F.explode(F.array("_old", "_new")).alias("chunk")).distinct()


def replace(table: str, rows: DataFrame, news: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full replace: (new table state, refused rows).

    A row that lacks a mandatory property is refused; omitted optional properties become null;
    foreign keys and derived columns are kept. ``news`` has ``id`` and property columns.
    """
    entity = schema.ENTITIES[table]

    def columns_of(names) -> list[str]:
        found = []
        for n in names:
            if n == "result" and table == "observation":
                found.append("result_type")
            else:
                found += list(schema.INTERVALS.get((table, n), ())[:2]) or [schema.column_name(n)]
        return found

    mandatory = [c for c in columns_of(entity.replace) if c in rows.columns]
    results = ("result_string", "result_number", "result_boolean", "result_json")
    optional = [c for c in columns_of(entity.optional) if c in rows.columns]
    written = mandatory + optional + [c for c in results if table == "observation"]
    complete = F.lit(True)
    for c in mandatory:
        complete = complete & (F.col(c).isNotNull() if c in news.columns else F.lit(False))
    refused = news.where(~complete)
    accepted = news.where(complete).select(
        "id", F.lit(True).alias("_hit"),
        *[
            (F.col(c) if c in news.columns else F.lit(None)).alias(f"_new_{c}") for c in written
        ],
    )
    joined = rows.join(accepted, "id", "left")
    state = joined.withColumns(
        {
            c: F.when(F.col("_hit"), F.col(f"_new_{c}").cast(rows.schema[c].dataType)).otherwise(F.col(c))
            for c in written
        }
    )
    return state.select(*rows.columns), refused


class PatchRejected(Exception):
    pass


class Spot:
    """One place of a document, by an RFC 6901 pointer: a holder and the key of the value in it.

    The document itself is the only element of a list around it, so every place has a holder.
    """

    def __init__(self, around: list, pointer: str | None):
        if pointer is None or pointer[:1] not in ("", "/"):
            raise PatchRejected(f"not a pointer: {pointer}")
        self.holder, self.key, self.around = around, 0, around
        self.path = pointer
        for part in pointer.split("/")[1:]:
            inner = self.value()
            if not isinstance(inner, (dict, list)):
                raise PatchRejected(f"nothing below {part}")
            self.holder, self.key = inner, part.replace("~1", "/").replace("~0", "~")

    def index(self, end: int) -> int:
        """Place in a list: decimal digits without leading zeros, below ``end``."""
        if isinstance(self.key, int):
            return self.key
        if not re.fullmatch("0|[1-9][0-9]{0,17}", self.key) or int(self.key) >= end:
            raise PatchRejected(f"no such element: {self.key}")
        return int(self.key)

    def value(self):
        if isinstance(self.holder, list):
            return self.holder[self.index(len(self.holder))]
        if self.key not in self.holder:
            raise PatchRejected(f"no such member: {self.key}")
        return self.holder[self.key]

    def add(self, value) -> None:
        if isinstance(self.holder, dict):
            self.holder[self.key] = value
        elif self.holder is self.around:
            self.around[0] = value
        elif self.key == "-":
            self.holder.append(value)
        else:
            self.holder.insert(self.index(len(self.holder) + 1), value)

    def replace(self, value) -> None:
        self.value()
        if isinstance(self.holder, dict):
            self.holder[self.key] = value
        else:
            self.holder[self.index(len(self.holder))] = value

    def take(self):
        """Removes and returns the value."""
        if self.holder is self.around:
            raise PatchRejected("the whole document cannot be removed")
        held = self.value()
        del self.holder[self.key if isinstance(self.holder, dict) else self.index(len(self.holder))]
        return held


def _equal(a, b) -> bool:
    """JSON equality: numbers by value, booleans only with booleans, at every depth."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def _parsed(text: str | None, what: str):
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        raise PatchRejected(f"the {what} is not JSON") from None


def patch_step(doc, op: str, path: str, origin: str | None, value: str | None):
    """Document after one RFC 6902 operation; raises ``PatchRejected``."""
    around = [doc]
    spot = Spot(around, path)
    if op == "add":
        spot.add(_parsed(value, "value"))
    elif op == "replace":
        spot.replace(_parsed(value, "value"))
    elif op == "test":
        if not _equal(spot.value(), _parsed(value, "value")):
            raise PatchRejected("test failed")
    elif op == "remove":
        spot.take()
    elif op == "copy":
        spot.add(copy.deepcopy(Spot(around, origin).value()))
    elif op == "move":
        source = Spot(around, origin)
        if path.startswith(f"{origin}/"):
            raise PatchRejected("cannot move into itself")
        if path != origin:
            held = source.take()
            Spot(around, path).add(held)
        else:
            source.value()
    else:
        raise PatchRejected(f"unknown operation: {op}")
    return around[0]


_PATCH_LAYOUT = "id long, doc string, patched boolean, reason string"


def _fold_patches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (id, seq); one document is held at a time, however many operations."""
    key = original = doc = reason = None
    steps = 0

    def finished():
        if reason is not None:
            return (key, original, False, reason)
        return (key, json.dumps(doc, separators=(",", ":"), ensure_ascii=False) if steps else original, steps > 0, None)

    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            if row.id != key:
                if key is not None:
                    done.append(finished())
                key, original, steps, reason = row.id, row.doc, 0, None
                doc = None
                continue
            if reason is None:
                try:
                    doc = _parsed(original, "document") if steps == 0 else doc
                    doc = patch_step(doc, row.op, row.path, row.origin, row.value)
                    steps += 1
                except PatchRejected as failure:
                    reason = str(failure)
        if done:
            yield pd.DataFrame(done, columns=["id", "doc", "patched", "reason"])
    if key is not None:
        yield pd.DataFrame([finished()], columns=["id", "doc", "patched", "reason"])


def json_patch(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """Documents (id, doc) after ordered patch operations (id, seq, op, path, origin, value).

    A failing operation rejects all operations of its id. Only touched documents go through Python;
    the fold streams over sorted operations, so a long list for one id needs no more memory.
    """
    ids = ops.select("id").distinct()
    touched = docs.join(ids, "id", "left_semi")
    header = touched.select(
        "id", F.lit(-1).cast("long").alias("seq"), "doc",
        *[F.lit(None).cast("string").alias(c) for c in ("op", "path", "origin", "value")],
    )
    steps = ops.join(docs.select("id"), "id", "left_semi").select(
        "id", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("string").alias("doc"),
        "op", "path", "origin", "value",
    )
    # Hashing the key makes sure the shuffle happens: a plain repartition by id is dropped when the
    # input claims that partitioning already, and adaptive execution may then undo it.
    folded = (
        header.unionByName(steps).repartition(F.xxhash64("id")).sortWithinPartitions("id", "seq")
        .mapInPandas(_fold_patches, _PATCH_LAYOUT)
    )
    untouched = docs.join(ids, "id", "left_anti").select(
        "id", "doc", F.lit(False).alias("patched"), F.lit(None).cast("string").alias("reason")
    )
    return untouched.unionByName(folded)


# -- relations -------------------------------------------------------------------------------


def relink(child: DataFrame, pairs: DataFrame, fk: str) -> DataFrame:
    """Children (by ``id``) get another parent (``parent_id``)."""
    return child.join(pairs.select("id", "parent_id"), "id", "left").withColumn(
        fk, F.coalesce("parent_id", fk)
    ).select(*child.columns)


def relocate(catalog: Catalog, pairs: DataFrame, ts: str, new: bool = False) -> Catalog:
    """Things (thing_id) move to a location (location_id).

    The link is replaced (added for new things); each move appends a historical location and links
    it to the location.
    """
    links = catalog.table("thing_location")
    moved = pairs.select("thing_id", "location_id").distinct()
    kept = links if new else links.join(moved.select("thing_id"), "thing_id", "left_anti")
    past = catalog.table("historical_location")
    steps = identity.assign_ids(moved, ["thing_id", "location_id"], identity.next_id(past))
    visits = steps.select("id", F.lit(ts).cast("timestamp").alias("time"), "thing_id")
    visited = steps.select("location_id", F.col("id").alias("historical_location_id"))
    return catalog.replace(
        thing_location=kept.unionByName(moved),
        historical_location=past.unionByName(visits, allowMissingColumns=True),
        location_historical_location=catalog.table("location_historical_location").unionByName(visited),
    )


def default_feature(catalog: Catalog, datastreams: DataFrame) -> DataFrame:
    """``datastream_id, location_id, gen_foi_id``: the first location of each datastream's thing.

    ``location_id`` is null where the thing has no location.
    """
    first = (
        catalog.table("thing_location").groupBy("thing_id")
        .agg(F.min("location_id").alias("location_id"))
    )
    located = datastreams.select(F.col("id").alias("datastream_id"), "thing_id").join(
        first, "thing_id", "left"
    )
    features = catalog.table("location").select(F.col("id").alias("location_id"), "gen_foi_id")
    return located.join(features, "location_id", "left").select(
        "datastream_id", "location_id", "gen_foi_id"
    )


def ensure_feature(catalog: Catalog, obs: DataFrame) -> tuple[Catalog, DataFrame, DataFrame]:
    """(catalog, observations with a feature, rejects) for observations that may lack a feature.

    A location's generated feature is reused; otherwise one feature per location is created and
    remembered by the location. Without a location the observation is rejected.
    """
    lacking = obs.where(F.col("feature_of_interest_id").isNull())
    needed = maintain.touched(lacking)
    datastreams = catalog.table("datastream").join(
        needed.withColumnRenamed("datastream_id", "id"), "id", "left_semi"
    )
    chain = default_feature(catalog, datastreams)
    features, locations = catalog.table("feature_of_interest"), catalog.table("location")
    bare = chain.where(F.col("location_id").isNotNull() & F.col("gen_foi_id").isNull())
    sources = locations.join(
        bare.select(F.col("location_id").alias("id")), "id", "left_semi"
    ).select(
        F.col("id").alias("_location"), "name", "description", "encoding_type",
        F.col("location").alias("feature"), "properties",
    )
    created = identity.assign_ids(sources, ["_location"], identity.next_id(features))
    stamps = created.select("_location", F.col("id").alias("_generated"))
    marked = (
        locations.join(stamps, F.col("id") == F.col("_location"), "left")
        .withColumn("gen_foi_id", F.coalesce("gen_foi_id", "_generated"))
        .select(*locations.columns)
    )
    chosen = chain.join(stamps, F.col("location_id") == F.col("_location"), "left").select(
        "datastream_id", F.coalesce("gen_foi_id", "_generated").alias("_feature")
    )
    filled = obs.join(chosen, "datastream_id", "left").withColumn(
        "feature_of_interest_id", F.coalesce("feature_of_interest_id", "_feature")
    ).select(*obs.columns)
    state = catalog.replace(
        feature_of_interest=features.unionByName(created.drop("_location"), allowMissingColumns=True),
        location=marked,
    )
    found = F.col("feature_of_interest_id").isNotNull()
    rejects = filled.where(~found).withColumn("reason", F.lit("the thing has no location"))
    return state, filled.where(found), rejects


def insert_observations(catalog: Catalog, obs: DataFrame) -> tuple[Catalog, DataFrame, DataFrame]:
    """(catalog, inserted, rejects): feature, uniqueness, ids, extents, area and last feature.

    ``obs`` has observation columns without ids and an input order column ``seq``.
    """
    from sensorquery.operators.loading import reject_duplicates

    state, ready, rejects = ensure_feature(catalog, obs)
    stored = state.table("observation")
    judged = materialize(reject_duplicates(ready, stored, ["seq"]))
    accepted = judged.where(F.col("status") == "accepted").drop("status")
    refused = judged.where(F.col("status") != "accepted").withColumnRenamed("status", "reason")
    inserted = identity.assign_ids(accepted, ["seq"], identity.next_id(stored)).drop("seq")
    streams = maintain.merge_extents(state.table("datastream"), inserted)
    areas = maintain.merge_area(
        streams.join(
            maintain.touched(inserted).withColumnRenamed("datastream_id", "id"), "id", "left_semi"
        ).select(F.col("id").alias("datastream_id"), "observed_area"),
        maintain.observed_area(inserted, state.table("feature_of_interest")),
    )
    streams = maintain.update_last_feature(maintain.set_area(streams, areas), inserted)
    state = state.replace(
        observation=stored.unionByName(inserted, allowMissingColumns=True), datastream=streams
    )
    return state, inserted, refused.unionByName(rejects.select(*refused.columns))


# -- delete ----------------------------------------------------------------------------------

# Child tables of each table, with their foreign key, parents before children.
CASCADE = {
    "network": [("datastream", "network_id")],
    "sensor": [("datastream", "sensor_id")],
    "observed_property": [("datastream", "observed_property_id")],
    "thing": [
        ("datastream", "thing_id"), ("historical_location", "thing_id"), ("thing_location", "thing_id"),
    ],
    "location": [
        ("thing_location", "location_id"), ("location_historical_location", "location_id"),
    ],
    "feature_of_interest": [("observation", "feature_of_interest_id")],
    "datastream": [("observation", "datastream_id")],
    "historical_location": [("location_historical_location", "historical_location_id")],
}
_LINKS = ("thing_location", "location_historical_location")


def cascade(catalog: Catalog, table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Ids (column ``id``) to delete per table along the foreign keys, the given rows included."""
    gone = {table: ids.select("id").distinct()}
    if table == "location":
        # Deleting a location also deletes the past locations of the things it holds.
        things = catalog.table("thing_location").join(
            ids.select(F.col("id").alias("location_id")), "location_id", "left_semi"
        ).select("thing_id").distinct()
        gone["historical_location"] = catalog.table("historical_location").join(
            things, "thing_id", "left_semi"
        ).select("id")
    for parent, children in CASCADE.items():
        if parent not in gone:
            continue
        for child, fk in children:
            if child in _LINKS or not catalog.has(child):
                continue
            keys = gone[parent].select(F.col("id").alias(fk))
            hit = catalog.table(child).join(keys, fk, "left_semi").select("id")
            gone[child] = gone[child].unionByName(hit).distinct() if child in gone else hit
    return gone


def delete(catalog: Catalog, name: str, ids: DataFrame) -> Catalog:
    """State after deleting entities by id, with everything that hangs on them.

    Where observations go but their datastream stays, its extents and area are repaired. A deleted
    feature is also forgotten by the location it was generated from.
    """
    table = schema.entity(name).table
    gone = cascade(catalog, table, ids)
    state = {
        t: catalog.table(t).join(keys, "id", "left_anti") for t, keys in gone.items()
    }
    for parent, children in CASCADE.items():
        for child, fk in children:
            if child in _LINKS and parent in gone and catalog.has(child):
                rows = state.get(child, catalog.table(child))
                state[child] = rows.join(gone[parent].select(F.col("id").alias(fk)), fk, "left_anti")
    after = catalog.replace(**state)
    if table in ("feature_of_interest", "observation"):
        lost = catalog.table("observation").join(gone["observation"], "id", "left_semi")
        after = _repair(after, lost)
    if table == "feature_of_interest":
        after = after.replace(location=_unlink_feature(after.table("location"), gone[table]))
    return after


def _unlink_feature(locations: DataFrame, features: DataFrame) -> DataFrame:
    gone = features.select(F.col("id").alias("gen_foi_id"), F.lit(True).alias("_gone"))
    return locations.join(gone, "gen_foi_id", "left").withColumn(
        "gen_foi_id", F.when(F.col("_gone").isNull(), F.col("gen_foi_id"))
    ).select(*locations.columns)


def _repair(state: Catalog, lost: DataFrame) -> Catalog:
    """Extents and area of the datastreams that lost observations."""
    remaining, hit = state.table("observation"), maintain.touched(lost)
    streams = maintain.shrink_extents(state.table("datastream"), lost, remaining)
    areas = maintain.observed_area(
        remaining.join(hit, "datastream_id", "left_semi"), state.table("feature_of_interest")
    )
    return state.replace(datastream=maintain.set_area(streams, areas, among=hit))


def delete_where(catalog: Catalog, predicate: Predicate | None) -> tuple[Catalog, DataFrame]:
    """(state, deleted observations) for a filter; the whole match set, whatever a page shows."""
    if predicate is None:
        raise ValueError("a delete needs a filter")
    obs = catalog.table("observation")
    lost = filter_rows(obs, "observation", predicate, catalog)
    kept = obs.join(lost.select("id"), "id", "left_anti")
    return _repair(catalog.replace(observation=kept), lost), lost
