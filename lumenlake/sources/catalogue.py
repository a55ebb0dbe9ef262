"""The catalogue tables with fixed schemas: read, written, and brought up to the schema where columns are missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BOX = "array<double>"
#: Columns of each table (fixed values: the catalogue's data model).
TABLES = {
    "photos": (
        "id string, filename string, content_type string, size bigint, width int, height int, sha256 string, phash string, dhash string, uploaded_at string, taken_at string, sharpness double, "
        "favorite boolean, clip array<float>, ai_status string, ai_worker string, ai_version int, ocr_text string, ocr_search string, "
        f"ocr_words array<struct<text:string,box:{_BOX},line:int>>, flatness double, jpeg_quality int, camera boolean, qr_codes array<struct<text:string,box:{_BOX}>>, core_hash string, receipt_fix map<string,string>"
    ),
    "matches": "photo_a string, photo_b string, kind string, similarity double",
    "faces": "id string, photo_id string, person_id string, x double, y double, w double, h double, embedding array<float>",
    "people": "id string, name string, created_at string, manual boolean",
    "albums": "id string, name string, created_at string",
    "album_photos": "album_id string, photo_id string",
    "workers": "name string, kind string, last_seen string",
    "deletions": "photo_id string, size bigint, duplicate boolean",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns in their order and types: missing ones null, others left out. Values that do not fit raise."""
    held = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


@dataclass
class Catalogue:
    """All catalogue tables by name."""

    tables: dict[str, DataFrame]

    @classmethod
    def load(cls, spark: SparkSession, root: str, kind: str = "parquet") -> Catalogue:
        """Read root/<table>; files that an older version wrote get the newer columns as nulls. Nothing is inferred."""
        return cls({name: spark.read.schema(schema(name)).format(kind).load(f"{root}/{name}") for name in TABLES})

    def save(self, root: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
        """Write every table that is there; a folder that is being read must not be overwritten."""
        for name, df in self.tables.items():
            conform(df, name).write.format(kind).mode(mode).save(f"{root}/{name}")
