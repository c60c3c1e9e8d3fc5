"""Schemas that drift between files (problem 1): rescue-column ingestion.

Each record is parsed once to a variant. Approved fields, under any of their names, are cast into
the columns of the target schema; what is unknown or does not cast is kept as JSON in ``rescued``.
A field approved later is replayed from there, without the source. Changes are read off the table so
made: the fields its columns were taken from and the rescued ones, against those of the revision
before. Which names are approved is data (``TargetSchema.approved``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.bind import let
from sheaf.operators.lagged import previous


@dataclass(frozen=True)
class Piece:
    """One piece of information: its names in the files and how its value becomes a column."""

    name: str
    names: tuple[str, ...]
    kind: str  # int, text, range, name


@dataclass(frozen=True)
class TargetSchema:
    """The table every file is read into; ``pieces`` hold the approved fields."""

    pieces: tuple[Piece, ...] = field(default_factory=tuple)

    def concept(self, name: Column) -> Column:
        """The piece a field name stands for, or null."""
        c = F.lit(None).cast("string")
        for p in self.pieces:
            c = F.when(name.isin(*p.names), p.name).otherwise(c)
        return c

    @classmethod
    def approved(cls, names: DataFrame, most: int = 10_000) -> TargetSchema:
        """The schema of a table (piece, kind, place, name) of approved names; more than ``most`` are refused.

        A piece's names are tried in the order of ``place``. A name approved for two pieces belongs
        to the first of them.
        """
        got = names.select("piece", "kind", "place", "name").where("piece is not null and name is not null").distinct().limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} approved names")
        by: dict[str, list] = {}
        for r in sorted(got, key=lambda r: (r["place"], r["piece"], r["name"])):
            by.setdefault(r["piece"], []).append(r)
        return cls(tuple(Piece(p, tuple(dict.fromkeys(r["name"] for r in rs)), rs[0]["kind"]) for p, rs in by.items()))

    def promote(self, piece: Piece) -> TargetSchema:
        """With one more approved piece, or other names of one."""
        return TargetSchema((*[p for p in self.pieces if p.name != piece.name], piece))

    def table(self, spark: SparkSession) -> DataFrame:
        """As a table for ``approved``."""
        rows = [(p.name, p.kind, 1000 * i + j, n) for i, p in enumerate(self.pieces) for j, n in enumerate(p.names)]
        return spark.createDataFrame(rows, "piece string, kind string, place int, name string")


# The names under which map files carry each piece of information.
MAP_SCHEMA = TargetSchema((
    Piece("page_offset", ("printed_to_pdf_offset", "printedToPdfOffset", "offset", "pdf_offset", "page_shift"), "int"),
    Piece("structure_notes", ("structure_notes", "structureNotes", "clean_notes", "cleanNotes", "clean"), "text"),
    Piece("target_range", ("target_pdf_range", "targetPdfRange", "target_pages", "body_range"), "range"),
    Piece("page_count", ("total_pdf_pages", "totalPages", "pages"), "int"),
    Piece("pdf_name", ("pdf_file", "pdfFile", "pdf_path"), "name"),
))


def parsed(raw: Column) -> Column:
    """The variant of a JSON object, or null where ``raw`` is no single readable object.

    Trailing text, repeated keys and values other than an object make a record unreadable.
    """
    return _single(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))))


def _single(boxed: Column) -> Column:
    """The object in a parsed list of just one."""
    one = F.try_variant_get(boxed, "$[1]", "variant").isNull() & F.schema_of_variant(F.try_variant_get(boxed, "$[0]", "variant")).startswith("OBJECT")
    return F.when(one, F.try_variant_get(boxed, "$[0]", "variant"))


def json_type(v: Column) -> Column:
    """string, number, boolean, array, object or null (JSON null) of a variant."""

    def named(s: Column) -> Column:
        return (
            F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
            .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
        )

    return let(F.schema_of_variant(v), named)


def _first_int(s: Column, pattern: str = r"([+-]?\d{1,9})") -> Column:
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("int")


def _cast(piece: Piece, v: Column, t: Column) -> Column:
    """The typed column of one field; null where its value does not cast."""
    text = F.try_variant_get(v, "$", "string")
    if piece.kind == "int":
        spelled = let(text, lambda s: F.when(s.rlike(r"(?i)^\s*printed\s*=\s*pdf\s*-"), _first_int(s, r"-\s*(\d{1,9})")).otherwise(_first_int(F.regexp_replace(s, r"([+-])\s+(?=\d)", "$1"))))
        return F.when(t == "number", F.try_variant_get(v, "$", "int")).when(t == "string", spelled).when(t == "object", F.try_variant_get(v, "$.value", "int"))
    if piece.kind == "text":
        joined = F.array_join(F.try_variant_get(v, "$", "array<string>"), " ")
        kept = F.concat_ws(" ", F.try_variant_get(v, "$.keep", "string"), F.try_variant_get(v, "$.skip", "string"))
        return F.when(t == "string", text).when(t == "array", joined).when((t == "object") & (kept != ""), kept)
    if piece.kind == "name":
        return F.when(t == "string", text).when(t == "object", F.try_variant_get(v, "$.name", "string"))
    ends = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    got = (
        F.when(t == "array", ends(F.try_variant_get(v, "$[0]", "int"), F.try_variant_get(v, "$[1]", "int")))
        .when(t == "object", ends(F.try_variant_get(v, "$.first", "int"), F.try_variant_get(v, "$.last", "int")))
        .when(t == "string", ends(_first_int(text, r"(\d{1,9})"), _first_int(text, r"\d+\D+(\d{1,9})")))
    )
    return F.when(got["first"].isNotNull() & got["last"].isNotNull(), got)


def ingest(df: DataFrame, keys: list[str], raw: str, prefer: str, schema: TargetSchema = MAP_SCHEMA) -> DataFrame:
    """The consistent table: keys, one typed column per piece, ``origin``, ``rescued``, ``rescued_types``.

    One row per readable revision; of several deliveries the readable one with the least ``prefer``
    is kept. A piece named several times takes the first castable field in the order of its names;
    ``origin`` maps each piece to the name and JSON type of the field it was taken from. Fields that
    are unknown or do not cast stay in ``rescued`` as they were, with their types beside them; a JSON
    null is rescued, too. Each record is read and parsed once.
    """
    # One step a projection: what a later step uses several times is not worked out several times.
    d = df.select(*keys, F.col(prefer).alias("_by"), F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]"))).alias("_box"))
    d = d.withColumn("_m", _single(F.col("_box")).cast("map<string,variant>")).drop("_box")
    d = d.withColumn("_t", F.transform_values("_m", lambda _, v: json_type(v)))
    at = {(p.name, n): f"_{i}_{j}" for i, p in enumerate(schema.pieces) for j, n in enumerate(p.names)}
    d = d.select("*", *[_cast(p, F.col("_m")[n], F.col("_t")[n]).alias(at[p.name, n]) for p in schema.pieces for n in p.names])
    kept, origin = [], []
    for p in schema.pieces:
        kept.append(F.coalesce(*[F.col(at[p.name, n]) for n in p.names]).alias(p.name))
        origin.append(F.coalesce(*[F.when(F.col(at[p.name, n]).isNotNull(), F.struct(F.lit(p.name).alias("key"), F.struct(F.lit(n).alias("name"), F.col("_t")[n].alias("type")).alias("value"))) for n in p.names]))
    d = d.select(*keys, "_by", "_m", "_t", *kept, F.map_from_entries(F.array_compact(F.array(*origin))).alias("origin"))
    # A second castable field of a piece is not taken: it is rescued.
    d = d.withColumn("_taken", F.transform(F.map_values("origin"), lambda o: o["name"]))
    left = lambda m: F.map_filter(F.col(m), lambda k, _: ~F.array_contains(F.col("_taken"), k))
    d = d.withColumn("rescued", F.to_json(left("_m"))).withColumn("rescued_types", left("_t"))
    row = F.struct(*[p.name for p in schema.pieces], "origin", "rescued", "rescued_types")
    first = d.groupBy(*keys).agg(F.min_by(row, F.when(F.col("_m").isNotNull(), F.struct(F.col("_by").isNull(), "_by"))).alias("_row"))
    return first.where(F.col("_row").isNotNull()).select(*keys, "_row.*")


def rows(ingested: DataFrame, keys: list[str], schema: TargetSchema = MAP_SCHEMA) -> DataFrame:
    """Keys, one typed column per piece and ``rescued``, JSON of all else."""
    return ingested.select(*keys, *[p.name for p in schema.pieces], "rescued")


def replay(table: DataFrame, piece: Piece, rescued: str = "rescued") -> DataFrame:
    """A later approved piece out of the rescued fields: fills (or adds) its column and takes it from there.

    Only the field that a value is taken from leaves ``rescued``; where the column is filled already
    nothing is taken.
    """
    d = table.withColumn("_m", F.try_parse_json(rescued).cast("map<string,variant>"))
    for i, n in enumerate(piece.names):
        v = F.col("_m")[n]
        d = d.withColumn(f"_c{i}", _cast(piece, v, json_type(v)))
    found = F.coalesce(*[F.col(f"_c{i}") for i in range(len(piece.names))])
    pick = F.coalesce(*[F.when(F.col(f"_c{i}").isNotNull(), F.lit(n)) for i, n in enumerate(piece.names)])
    have = F.coalesce(F.col(piece.name), found) if piece.name in table.columns else found
    pick = F.when(F.col(piece.name).isNull(), pick) if piece.name in table.columns else pick
    left = F.to_json(F.map_filter(F.col("_m"), lambda k, _: ~k.eqNullSafe(pick)))
    return d.withColumn(piece.name, have).withColumn(rescued, left).drop("_m", *[f"_c{i}" for i in range(len(piece.names))])


def changes(ingested: DataFrame, keys: list[str], order: str, schema: TargetSchema = MAP_SCHEMA, width: int = 64) -> DataFrame:
    """(keys, order, field_name, change_kind): every change against the next lower readable revision.

    The fields of a revision are those its typed columns were taken from and those rescued. Give a
    written table: it is read twice.

    ``renamed`` (under the new name) if a field went and another of the same piece came, ``added``
    and ``removed`` otherwise, ``retyped`` if the JSON type differs, also across a rename. A null
    is present without a type. Several names of one piece that go or come at once pair in
    alphabetical order. The first readable revision of a file has no changes.
    """
    entry = lambda n, t: F.struct(n.alias("key"), t.alias("value"))
    types = F.map_from_entries(F.concat(F.transform(F.map_values("origin"), lambda o: entry(o["name"], o["type"])), F.transform(F.map_entries("rescued_types"), lambda e: entry(e["key"], e["value"]))))
    d = previous(ingested.select(*keys, order, types.alias("types")), keys, order, ["types"], F.floor(F.col(order) / width)).where(F.col("types_before").isNotNull())

    def sided(here: str, there: str) -> Column:
        only = F.array_sort(F.array_except(F.map_keys(here), F.map_keys(there)))
        return F.transform(only, lambda n: F.struct(n.alias("name"), schema.concept(n).alias("piece"), F.col(here)[n].alias("type")))

    d = d.withColumn("_came", sided("types", "types_before")).withColumn("_went", sided("types_before", "types"))

    def nth(side: str, other: str):
        """Each field with its place among those of its piece, and the partner at that place."""

        def placed(f: Column, i: Column) -> Column:
            rank = F.size(F.filter(F.slice(F.col(side), F.lit(1), i), lambda g: g["piece"] == f["piece"]))
            return F.struct(f["name"].alias("name"), f["type"].alias("type"), F.get(F.filter(F.col(other), lambda g: g["piece"] == f["piece"]), rank).alias("partner"))

        return F.transform(F.col(side), placed)

    d = d.withColumn("_c", nth("_came", "_went")).withColumn("_w", nth("_went", "_came"))
    change = lambda n, k: F.struct(n.alias("field_name"), F.lit(k).alias("change_kind"))
    differ = lambda a, b: (a != b) & (a != "null") & (b != "null")
    renamed = F.filter("_c", lambda f: f["partner"].isNotNull())
    both = F.array_intersect(F.map_keys("types"), F.map_keys("types_before"))
    out = F.concat(
        F.transform(renamed, lambda f: change(f["name"], "renamed")),
        F.transform(F.filter("_c", lambda f: f["partner"].isNull()), lambda f: change(f["name"], "added")),
        F.transform(F.filter("_w", lambda f: f["partner"].isNull()), lambda f: change(f["name"], "removed")),
        F.transform(F.filter(renamed, lambda f: differ(f["type"], f["partner"]["type"])), lambda f: change(f["name"], "retyped")),
        F.transform(F.filter(both, lambda n: differ(F.col("types")[n], F.col("types_before")[n])), lambda n: change(n, "retyped")),
    )
    return d.select(*keys, order, F.inline(out))
