"""Reads over the data model: filter, navigate, expand, order, page, count and select.

A ``Query`` is an immutable description; every method returns a new one and every result is a lazy
DataFrame. Filters are functions of a resolver: ``lambda r: P.gt(r("result"), 3)``. A resolver path
may cross relations (``r("Datastream/Thing/name")``); the relation graph decides how they join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorquery import schema
from sensorquery.catalog import Catalog
from sensorquery.functions import render
from sensorquery.functions.values import Interval, Result
from sensorquery.operators import series

Predicate = Callable[[Callable], Column]
PAGE_ROWS = 4096  # of a keyset page that one task gathers


@dataclass(frozen=True)
class Expand:
    """Options of one expanded relation; ``expand`` nests further relations.

    ``top`` bounds the children that are put into one document of the parent, so a relation towards
    many needs it there. ``Query.children`` gives all of them, as rows.
    """

    navigation: str
    filter: Predicate | None = None
    select: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    top: int | None = None
    skip: int = 0
    count: bool = False
    expand: tuple[Expand, ...] = ()


class Resolver:
    """Turns property paths into Columns and remembers the relations and columns they need."""

    def __init__(self, table: str):
        self.table = table
        self.hops: dict[tuple[str, ...], set[str]] = {}

    def __call__(self, path: str):
        table, hop, steps = self.table, (), path.split("/")
        while len(steps) > 1 and self._is_relation(table, steps[0]):
            target = schema.relation(table, steps[0])
            if hop:
                self.hops[hop].add(target.near)
            hop, table = (*hop, steps.pop(0)), target.target
            self.hops.setdefault(hop, {target.far})
        prop, *inner = steps
        schema.check_property(table, prop)

        def column(name: str) -> Column:
            if not hop:
                return F.col(name)
            self.hops[hop].add(name)
            return F.col(hop_column(hop, name))

        value = render.property_value(table, prop, column)
        if inner:
            if prop in schema.GEOMETRY_PROPERTIES or prop == "unitOfMeasurement":
                return value[inner[0]]
            return F.get_json_object(value, "$" + "".join(f"['{p}']" for p in inner))
        return value

    @staticmethod
    def _is_relation(table: str, name: str) -> bool:
        return name == "Commit" or name in schema.ENTITIES[table].relations

    def crosses_many(self) -> bool:
        for hop in self.hops:
            table = self.table
            for step in hop:
                target = schema.relation(table, step)
                if target.many:
                    return True
                table = target.target
        return False


def hop_column(hop: tuple[str, ...], name: str) -> str:
    return "__".join((*hop, name))


def filter_rows(df: DataFrame, table: str, predicate: Predicate, catalog: Catalog) -> DataFrame:
    """Rows of an entity table that satisfy a predicate over its own and related properties.

    Relations towards one row are plain inner joins, so time predicates still reach the scan. As
    soon as a path crosses a relation towards many rows the whole filter becomes a semi join.
    """
    resolve = Resolver(table)
    condition = predicate(resolve)
    if not resolve.hops:
        return df.where(condition)
    joined = df
    for hop in sorted(resolve.hops, key=len):
        joined = _join_hop(joined, table, hop, sorted(resolve.hops[hop]), catalog)
    matched = joined.where(condition)
    if not resolve.crosses_many():
        return matched.select(*df.columns)
    ids = matched.select("id").distinct()
    return df.join(ids, "id", "left_semi")


def _join_hop(
    df: DataFrame, table: str, hop: tuple[str, ...], needed: list[str], catalog: Catalog
) -> DataFrame:
    for step in hop[:-1]:
        table = schema.relation(table, step).target
    target = schema.relation(table, hop[-1])
    near = hop_column(hop[:-1], target.near) if hop[:-1] else target.near
    far = catalog.table(target.target).select(
        *[F.col(c).alias(hop_column(hop, c)) for c in needed]
    )
    if target.link is None:
        return df.join(far, F.col(near) == F.col(hop_column(hop, target.far)))
    link = catalog.table(target.link).select(
        F.col(target.link_near).alias("_link_near"), F.col(target.link_far).alias("_link_far")
    )
    return (
        df.join(link, F.col(near) == F.col("_link_near"))
        .join(far, F.col("_link_far") == F.col(hop_column(hop, target.far)))
        .drop("_link_near", "_link_far")
    )


def related_ids(
    parents: DataFrame, table: str, navigation: str, catalog: Catalog
) -> tuple[DataFrame, schema.Relation]:
    """Keys (``_key``) that select the rows reached from some parents over one relation."""
    target = schema.relation(table, navigation)
    if target.link is None:
        return parents.select(F.col(target.near).alias("_key")).distinct(), target
    link = catalog.table(target.link)
    keys = link.join(
        parents.select(F.col("id").alias("_parent")), link[target.link_near] == F.col("_parent"),
        "left_semi",
    )
    return keys.select(F.col(target.link_far).alias("_key")).distinct(), target


def order_columns(df: DataFrame, table: str, specs: tuple[str, ...]) -> list[Column]:
    """Sort keys: ascending puts nulls last, descending puts them first; text sorts by bytes."""
    return [
        value.desc_nulls_first() if descending else value.asc_nulls_last()
        for value, descending in _key_parts(df, table, specs)
    ]


def _key_parts(df: DataFrame, table: str, specs: tuple[str, ...]) -> list[tuple[Column, bool]]:
    """Values to sort by, and whether each descends."""
    columns = []
    for spec in specs:
        name, _, direction = spec.partition(" ")
        if direction not in ("", "asc", "desc"):
            raise ValueError(f"unknown sort direction: {direction}")
        resolve = Resolver(table)
        value = resolve(name)
        if resolve.hops:
            raise ValueError("sort keys are properties of the entity itself")
        if isinstance(value, Interval):
            parts = [value.lower, value.upper]
        elif isinstance(value, Result):
            parts = result_order(value)
        else:
            parts = [value]
        columns += [(p, direction == "desc") for p in parts]
    return columns


def result_order(r: Result) -> list[Column]:
    """Mixed results sort by kind first: text, numbers, booleans, arrays, objects."""
    rank = (
        F.when(r.type == schema.RESULT_STRING, 0)
        .when(r.type == schema.RESULT_NUMBER, 1)
        .when(r.type == schema.RESULT_BOOLEAN, 2)
        .when((r.type == schema.RESULT_JSON) & F.ltrim(r.json).startswith("["), 3)
        .when(r.type == schema.RESULT_JSON, 4)
    )
    return [
        rank,
        F.when(rank == 0, r.string),
        F.when(rank == 1, r.number),
        F.when(rank == 2, r.boolean),
        F.when(rank >= 3, r.json),
    ]


@dataclass(frozen=True)
class Query:
    catalog: Catalog
    table: str
    base: str = ""
    predicates: tuple[Predicate, ...] = ()
    restrictions: tuple[Callable[[DataFrame, Catalog], DataFrame], ...] = ()
    selection: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0
    expands: tuple[Expand, ...] = field(default=())

    @classmethod
    def on(cls, catalog: Catalog, name: str, base: str = "") -> Query:
        return cls(catalog, schema.entity(name).table, base)

    # -- description -------------------------------------------------------------------------

    def filter(self, predicate: Predicate) -> Query:
        return replace(self, predicates=(*self.predicates, predicate))

    def by_id(self, value: int) -> Query:
        return self.filter(lambda r: r("id") == value)

    def where_any(self, navigation: str, predicate: Predicate) -> Query:
        """At least one related row satisfies the predicate."""
        return self._where_related(navigation, predicate, "left_semi")

    def where_all(self, navigation: str, predicate: Predicate) -> Query:
        """No related row fails the predicate."""

        def failing(r):
            return ~F.coalesce(predicate(r), F.lit(False))

        return self._where_related(navigation, failing, "left_anti")

    def _where_related(self, navigation: str, predicate: Predicate, how: str) -> Query:
        table = self.table

        def restrict(df: DataFrame, catalog: Catalog) -> DataFrame:
            target = schema.relation(table, navigation)
            rows = filter_rows(catalog.table(target.target), target.target, predicate, catalog)
            key = F.col(target.far).alias("_key")
            if target.link is not None:
                link = catalog.table(target.link)
                rows = link.join(
                    rows.select(F.col("id").alias("_far")), link[target.link_far] == F.col("_far"),
                    "left_semi",
                )
                key = F.col(target.link_near).alias("_key")
            keys = rows.select(key).distinct()
            return df.join(keys, df[target.near] == keys["_key"], how)

        return replace(self, restrictions=(*self.restrictions, restrict))

    def navigate(self, navigation: str, key: int | None = None) -> Query:
        """Follow a relation: the new query reads only rows related to the rows of this one."""
        source = self
        target = schema.relation(self.table, navigation)

        def restrict(df: DataFrame, catalog: Catalog) -> DataFrame:
            keys, rel = related_ids(source.rows(), source.table, navigation, catalog)
            return df.join(keys, df[rel.far] == keys["_key"], "left_semi")

        step = Query(self.catalog, target.target, self.base, restrictions=(restrict,))
        return step if key is None else step.by_id(key)

    def select(self, *props: str) -> Query:
        return replace(self, selection=props)

    def order_by(self, *specs: str) -> Query:
        return replace(self, order=specs)

    def top(self, n: int) -> Query:
        return replace(self, limit=n)

    def skip(self, n: int) -> Query:
        return replace(self, offset=n)

    def expand(self, *options: Expand | str) -> Query:
        added = tuple(Expand(o) if isinstance(o, str) else o for o in options)
        return replace(self, expands=(*self.expands, *added))

    def as_of(self, t) -> Query:
        return replace(self, catalog=self.catalog.as_of(t))

    def from_to(self, start, end) -> Query:
        return replace(self, catalog=self.catalog.from_to(start, end))

    # -- rows --------------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """All matching rows with table columns, neither ordered nor paged."""
        if self.catalog.span is not None and any(e.navigation != "Commit" for e in self.expands):
            raise ValueError("a span of validity can only expand Commit")
        df = self.catalog.table(self.table)
        for restrict in self.restrictions:
            df = restrict(df, self.catalog)
        for predicate in self.predicates:
            df = filter_rows(df, self.table, predicate, self.catalog)
        return df

    def sort_keys(self, df: DataFrame) -> list[Column]:
        """User order, then id (and validity when reading a span) as the tie breaker."""
        keys = order_columns(df, self.table, self.order)
        keys.append(F.col("id").asc_nulls_last())
        if self.catalog.span is not None and "valid_from" in df.columns:
            keys.append(F.col("valid_from").asc_nulls_last())
        return keys

    def page_rows(self, extra: int = 0) -> DataFrame:
        """Ordered rows of the current page; ``extra`` rows more to see whether there is a next."""
        df = self.rows()
        return df.orderBy(*self.sort_keys(df)).offset(self.offset).limit(self._size() + extra)

    def _size(self) -> int:
        if self.limit is None:
            raise ValueError("a page needs top(); rows(), pages() and all_documents() give everything")
        return self.limit

    def page(self) -> tuple[DataFrame, DataFrame]:
        """(rows of the page, one row with ``next_skip``: null on the last page)."""
        sentinel = self.page_rows(extra=1)
        keys = self.sort_keys(sentinel)
        seen = sentinel.agg(F.count("*").alias("n"))
        following = seen.select(
            F.when(F.col("n") > self._size(), F.lit(self.offset + self._size())).alias("next_skip")
        )
        return sentinel.orderBy(*keys).limit(self.limit), following

    def pages(self, size: int) -> DataFrame:
        """All matching rows with their 0-based ``page`` of a full walk, without gaps or repeats."""
        df = self.rows()
        placed = series.global_positions(df, self.sort_keys(df), "_pos")
        return placed.withColumn("page", series.range_of(F.col("_pos"), size)).drop("_pos")

    def page_after(self, seen: dict[str, object] | None, size: int) -> DataFrame:
        """Keyset page: the first rows (``seen`` None), or those behind the last row seen.

        The order is the query's own, then ``id``. Each row carries its place in columns ``_k0``,
        ``_k1``, ...; ``seen`` is a mapping with those of the last row (``row.asDict()`` will do).
        Nulls stand where the order puts them and are never skipped. Unlike a deep skip the cost does
        not depend on how many rows came before. A page of more than PAGE_ROWS rows is cut by position
        from a distributed sort, since a smaller one gathers its rows in one task.
        """
        df = self.rows()
        keys = _key_parts(df, self.table, self.order)
        keys.append((F.col("id"), False))
        if self.catalog.span is not None and "valid_from" in df.columns:
            keys.append((F.col("valid_from"), False))
        placed = df.withColumns({f"_k{i}": value for i, (value, _) in enumerate(keys)})
        if seen is not None:
            behind, equal = F.lit(False), F.lit(True)
            for i, (_, descending) in enumerate(keys):
                here, last = F.col(f"_k{i}"), F.lit(seen[f"_k{i}"]).cast(placed.schema[f"_k{i}"].dataType)
                # Ascending puts nulls last, descending first: a null is the largest value of all.
                if descending:
                    later = here < last if seen[f"_k{i}"] is not None else here.isNotNull()
                else:
                    later = (here > last) | here.isNull() if seen[f"_k{i}"] is not None else F.lit(False)
                behind = behind | (equal & F.coalesce(later, F.lit(False)))
                equal = equal & here.eqNullSafe(last)
            placed = placed.where(behind)
        order = [
            F.col(f"_k{i}").desc_nulls_first() if descending else F.col(f"_k{i}").asc_nulls_last()
            for i, (_, descending) in enumerate(keys)
        ]
        if size <= PAGE_ROWS:
            return placed.orderBy(*order).limit(size)
        return series.global_positions(placed, order, "_pos").where(F.col("_pos") < size).drop("_pos").orderBy(*order)

    def count_total(self) -> DataFrame:
        """One row ``count``: the exact number of matching rows, whatever the page. Ids (with their
        validity when reading a span) are unique and filters never multiply rows, so nothing is
        shuffled but partial counts."""
        return self.rows().agg(F.count("*").alias("count"))

    def count_capped(self, threshold: int) -> DataFrame:
        """One row: ``count`` up to the threshold, and whether there are more (``capped``). Reads no
        further than it has to."""
        seen = self.rows().select("id").limit(threshold + 1).agg(F.count("*").alias("n"))
        return seen.select(F.least("n", F.lit(threshold)).alias("count"), (F.col("n") > threshold).alias("capped"))

    def count_estimate(self) -> DataFrame:
        """One row ``count``: a sketch's estimate of the distinct matching rows (about 2 percent)."""
        df = self.rows()
        spanning = self.catalog.span is not None and "valid_from" in df.columns
        key = F.struct("id", "valid_from") if spanning else F.col("id")
        return df.agg(F.approx_count_distinct(key, 0.02).alias("count"))

    # -- expanded relations ------------------------------------------------------------------

    def expand_rows(self, option: Expand) -> DataFrame:
        """Flat form of one expanded relation: ``parent_id``, ``rn``, child columns and ``total``.
        ``top`` children of each parent; see ``children`` for all."""
        parents = self.rows()
        rows = child_rows(parents, self.table, option, self.catalog)
        in_page = (F.col("rn") > option.skip) & (F.col("rn") <= option.skip + option.top)
        return rows.where(in_page).withColumn("rn", F.col("rn") - option.skip)

    def children(self, option: Expand) -> DataFrame:
        """All children of one expanded relation, for bulk export: ``parent_id`` and child columns.
        Rows stay rows, so a parent may have any number of them."""
        return related_children(self.rows(), self.table, option, self.catalog)

    def documents(self, extra: int = 0) -> DataFrame:
        """``id``, ``position`` and ``json`` of the documents of the page, expanded relations
        embedded."""
        df = self.page_rows(extra)
        # A page is bounded by its size, so numbering it needs no partitions.
        place = Window.partitionBy(F.lit(0)).orderBy(*self.sort_keys(df))
        placed = df.withColumn("_position", F.row_number().over(place))
        embedded = expand_columns(placed, self.table, self.expands, self.catalog, self.base)
        return embedded.select(
            "id", F.col("_position").alias("position"), self._output(embedded).alias("json")
        )

    def all_documents(self) -> DataFrame:
        """``id`` and ``json`` of every matching row, for bulk export. Relations towards many are cut
        to their ``top`` inside a document; ``children`` exports all of them."""
        embedded = expand_columns(self.rows(), self.table, self.expands, self.catalog, self.base)
        return embedded.select("id", self._output(embedded).alias("json"))

    def _output(self, df: DataFrame) -> Column:
        names = self.selection or tuple(
            schema.default_select(self.table, versioned=_versioned(self.catalog, df))
        )
        expanded = {e.navigation for e in self.expands}
        return entity_json(
            self.table, names, expanded, self.base, self.catalog.instant,
            [c for c in df.columns if c.startswith("_x_")],
        )

    def projected(self) -> DataFrame:
        """Matching rows in output form: selected properties as columns, ``id`` as ``@iot.id``,
        and the read instant when reading in the past."""
        df = self.rows()
        names = self.selection or tuple(
            schema.default_select(self.table, versioned=_versioned(self.catalog, df))
        )
        stamp = self.catalog.instant
        columns = [
            render.output_column(self.table, n, F.col, base=self.base, as_of=stamp) for n in names
        ]
        out = df.select(*columns)
        if "id" in out.columns:
            out = out.withColumnRenamed("id", "@iot.id")
        if stamp is not None and self.table != "commit_log":
            out = out.withColumn("@iot.as_of", F.lit(stamp))
        return out


def _versioned(catalog: Catalog, df: DataFrame) -> bool:
    return "valid_from" in df.columns and (catalog.instant is not None or catalog.span is not None)


def entity_json(
    table: str, names, expanded: set[str], base: str, as_of: str | None, extra: list[str]
) -> Column:
    """JSON text of one entity: selected members, then the expanded relations."""
    members: dict[str, Column] = {}
    for name in names:
        if name in expanded:
            continue
        column = render.output_column(table, name, F.col, base=base, as_of=as_of)
        label = {"id": "@iot.id", "selfLink": "@iot.selfLink"}.get(name, name)
        if name in schema.ENTITIES[table].relations or name == "Commit":
            label = f"{name}@iot.navigationLink"
        members[label] = column
    for column in extra:
        members[column.removeprefix("_x_")] = F.col(f"`{column}`")
    embedded = {c.removeprefix("_x_") for c in extra if not c.endswith(("count", "nextLink"))}
    return render.document(members, embedded)


def related_children(
    parents: DataFrame, table: str, option: Expand, catalog: Catalog
) -> DataFrame:
    """Children of the given parents only: ``parent_id`` and child columns."""
    target = schema.relation(table, option.navigation)
    children = catalog.table(target.target)
    if option.filter is not None:
        children = filter_rows(children, target.target, option.filter, catalog)
    if target.link is not None:
        link = catalog.table(target.link).select(
            F.col(target.link_near).alias("parent_id"), F.col(target.link_far).alias("_far")
        )
        children = children.join(link, F.col(target.far) == F.col("_far")).drop("_far")
    else:
        children = children.withColumn("parent_id", F.col(target.far))
    keys = parents.select(F.col(target.near).alias("parent_id")).distinct()
    return children.join(keys, "parent_id", "left_semi")


def child_rows(
    parents: DataFrame, table: str, option: Expand, catalog: Catalog
) -> DataFrame:
    """Ranked children of each parent: ``parent_id``, ``rn``, child columns and ``total``.

    Keeps at most ``skip + top + 1`` rows per parent; the last one only tells that there are more.
    Totals are a separate partial aggregate, so no parent's children ever meet in one task.
    """
    if option.top is None:
        raise ValueError(f"{option.navigation} needs top; children() gives all rows")
    target = schema.relation(table, option.navigation)
    children = related_children(parents, table, option, catalog)
    order = [*order_columns(children, target.target, option.order), F.col("id").asc_nulls_last()]
    ranked = series.top_per_key(children, ["parent_id"], order, option.skip + option.top + 1)
    if not option.count:
        return ranked.withColumn("total", F.lit(None).cast("long"))
    totals = children.groupBy("parent_id").agg(F.count("*").alias("total"))
    return ranked.join(totals, "parent_id")


def expand_columns(
    df: DataFrame, table: str, options: tuple[Expand, ...], catalog: Catalog, base: str
) -> DataFrame:
    """Adds one JSON column ``_x_<navigation>`` per expanded relation, deepest level first."""
    for option in options:
        target = schema.relation(table, option.navigation)
        name = f"_x_{option.navigation}"
        if not target.many:
            df = _embed_one(df, target, option, catalog, base, name)
        else:
            df = _embed_many(df, table, target, option, catalog, base, name)
    return df


def _child_json(rows: DataFrame, option: Expand, target, base: str, catalog: Catalog) -> Column:
    names = option.select or tuple(
        schema.default_select(target.target, versioned=_versioned(catalog, rows))
    )
    extra = [c for c in rows.columns if c.startswith("_x_")]
    return entity_json(
        target.target, names, {e.navigation for e in option.expand}, base, catalog.instant, extra
    )


def _embed_one(df, target, option: Expand, catalog: Catalog, base: str, name: str) -> DataFrame:
    """To-one: the parent object, or ``{}`` without a match."""
    parents = catalog.table(target.target)
    if option.filter is not None:
        parents = filter_rows(parents, target.target, option.filter, catalog)
    needed = df.select(F.col(target.near).alias("_key")).distinct()
    parents = parents.join(needed, F.col(target.far) == F.col("_key"), "left_semi")
    parents = expand_columns(parents, target.target, option.expand, catalog, base)
    body = _child_json(parents, option, target, base, catalog)
    packed = parents.select(F.col(target.far).alias("_key"), body.alias(name))
    return (
        df.join(packed, df[target.near] == packed["_key"], "left")
        .drop("_key")
        .withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit("{}")))
    )


def _embed_many(
    df, table: str, target, option: Expand, catalog: Catalog, base: str, name: str
) -> DataFrame:
    """To-many: an array cut to the page of each parent, its count and the link to the rest."""
    rows = child_rows(df, table, replace(option, count=False), catalog)
    last = option.skip + option.top  # child_rows has refused a missing top
    rows = expand_columns(rows.where(F.col("rn") > option.skip), target.target, option.expand, catalog, base)
    body = _child_json(rows, option, target, base, catalog)
    # At most top + 1 documents per parent meet here.
    packed = rows.groupBy("parent_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("rn") <= last, F.struct(F.col("rn"), body.alias("doc"))))
        ).alias("_docs"),
        (F.max("rn") > last).alias("_more"),
    ).withColumnRenamed("parent_id", "_key")
    joined = df.join(packed, df[target.near] == packed["_key"], "left").drop("_key")
    listed = F.transform(F.col("_docs"), lambda d: d["doc"])
    array = F.concat(F.lit("["), F.coalesce(F.array_join(listed, ","), F.lit("")), F.lit("]"))
    follow = F.concat(
        render.nav_link(table, option.navigation, F.col("id"), base),
        F.lit(f"?$top={option.top}&$skip={last}"),
    )
    joined = joined.withColumn(name, array).withColumn(
        f"{name}@iot.nextLink", F.when(F.col("_more"), follow)
    )
    if option.count:
        counted = related_children(df, table, option, catalog)
        totals = counted.groupBy(F.col("parent_id").alias("_key")).agg(F.count("*").alias("_total"))
        joined = joined.join(totals, joined[target.near] == totals["_key"], "left").withColumn(
            f"{name}@iot.count", F.coalesce(F.col("_total"), F.lit(0))
        ).drop("_key", "_total")
    return joined.drop("_docs", "_more")

