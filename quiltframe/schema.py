"""Pointers, feature spaces and field markers as Spark types with metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SPARSE = _struct(zarr_group=T.StringType(), start=T.LongType(), end=T.LongType(), zarr_row=T.LongType())
DENSE = _struct(zarr_group=T.StringType(), position=T.LongType())
SPATIAL = _struct(zarr_group=T.StringType(), min_corner=T.ArrayType(T.LongType()), max_corner=T.ArrayType(T.LongType()))
POINTERS = {"sparse": SPARSE, "dense": DENSE, "spatial": SPATIAL}


@dataclass(frozen=True)
class FeatureSpace:
    """A modality: its pointer, layers (required ones in must) and whether rows share features."""

    name: str
    pointer: str
    layers: dict[str, str]
    must: tuple[str, ...]
    has_features: bool = True
    by_feature: bool = False
    endpoints: tuple[str, ...] = field(default=("matrix",))

    def __post_init__(self) -> None:
        if self.pointer not in POINTERS:
            raise ValueError(f"unknown pointer type {self.pointer!r}")
        if missing := set(self.must) - set(self.layers):
            raise ValueError(f"required layers are not declared: {sorted(missing)}")
        if not self.has_features and "matrix" in self.endpoints:
            object.__setattr__(self, "endpoints", tuple(e for e in self.endpoints if e != "matrix"))


SPACES: dict[str, FeatureSpace] = {}


def register_space(space: FeatureSpace) -> FeatureSpace:
    """Adds a modality; a name may be taken once."""
    if space.name in SPACES:
        raise ValueError(f"feature space {space.name!r} is registered already")
    SPACES[space.name] = space
    return space


for _s in (
    FeatureSpace("gene_expression", "sparse", {"counts": "bigint", "log_normalized": "float", "tpm": "float"}, ("counts",), by_feature=True),
    FeatureSpace("image_features", "dense", {"raw": "float", "log_normalized": "float", "ctrl_standardized": "float"}, ("ctrl_standardized",)),
    FeatureSpace("protein_abundance", "dense", {"counts": "bigint", "clr_normalized": "float", "dsb_normalized": "float"}, ("counts",)),
    FeatureSpace("chromatin_accessibility", "sparse", {"starts": "bigint", "lengths": "int"}, ("starts", "lengths"), by_feature=True, endpoints=("fragments",)),
    FeatureSpace("image_tiles", "dense", {"raw": "float"}, ("raw",), has_features=False, endpoints=("spatial",)),
    FeatureSpace("discrete_image", "spatial", {"raw": "float", "semantic_masks": "boolean", "instance_masks": "bigint"}, ("raw",), has_features=False, endpoints=("spatial",)),
):
    register_space(_s)


def pointer(name: str, space: str, nullable: bool = True, **markers: object) -> T.StructField:
    """A pointer column of a feature space."""
    if space not in SPACES:
        raise ValueError(f"unknown feature space {space!r}")
    return T.StructField(name, POINTERS[SPACES[space].pointer], nullable, {"feature_space": space, **markers})


def marked(name: str, kind: T.DataType, **markers: object) -> T.StructField:
    """A column with markers: stable_uid, registry_key, polymorphic_registry_key, ontology_aligned, cross_reference, summary."""
    return T.StructField(name, kind, True, dict(markers))


def pointer_kind(t: T.DataType) -> str | None:
    """Which pointer a struct type is, by its field names."""
    names = set(t.fieldNames()) if isinstance(t, T.StructType) else None
    return next((k for k, s in POINTERS.items() if set(s.fieldNames()) == names), None)


def pointers(schema: T.StructType) -> dict[str, str]:
    """Pointer column -> feature space, from metadata, else from the column's own name."""
    out = {}
    for f in schema.fields:
        if kind := pointer_kind(f.dataType):
            space = f.metadata.get("feature_space", f.name)
            if space not in SPACES:
                raise ValueError(f"column {f.name!r} points to no feature space")
            if SPACES[space].pointer != kind:
                raise ValueError(f"column {f.name!r} has a {kind} pointer, {space} needs {SPACES[space].pointer}")
            out[f.name] = space
    return out


def check_obs(schema: T.StructType) -> None:
    """An obs schema has uid, dataset_uid and a pointer; one stable uid at most."""
    names = schema.fieldNames()
    for need in ("uid", "dataset_uid"):
        if need not in names:
            raise ValueError(f"no column {need!r}")
    if not pointers(schema):
        raise ValueError("no pointer column")
    if sum(bool(f.metadata.get("stable_uid")) for f in schema.fields) > 1:
        raise ValueError("more than one stable uid")


def align(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """df in the columns of schema: renamed, missing nullable ones null, others dropped."""
    df = df.withColumnsRenamed(renames or {})
    if missing := [f.name for f in schema.fields if f.name not in df.columns and not f.nullable]:
        raise ValueError(f"required columns are missing: {missing}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields])


def least_type(kinds: list[str]) -> str:
    """The least numeric type that holds all: float with an integer of more than 16 bits is double."""
    order = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]
    if not kinds or any(k not in order for k in kinds):
        raise ValueError(f"no common type of {kinds}")
    top = max(kinds, key=order.index)
    return "double" if top == "float" and {"int", "bigint"} & set(kinds) else top
