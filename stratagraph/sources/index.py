"""The index: every file's extraction as nested rows, the relations in it, and its storage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from stratagraph.extract import packs
from stratagraph.extract.model import NAMES, PARTS, PLACES, digest, rows
from stratagraph.schema import FORMAT_VERSION
from stratagraph.staging import observed

SYMBOLS = "array<struct<id:string,file:string,ord:int,kind:string,raw:string,start_line:int,end_line:int,signature:string,docstring:string,is_exported:boolean,public:boolean,markers:array<string>,parent:string,source_hash:string,interface_hash:string,is_top_level:boolean,bytes:long>>"
IMPORTS = "array<struct<ord:int,specifier:string,imported_name:string,local_name:string,form:string,paths:array<string>>>"
INDEX = f"file string, text string, pack string, source_kind string, role string, source_hash string, fingerprint string, parse_errors int, symbols {SYMBOLS}, imports {IMPORTS}, flows array<struct<ord:int,kind:string,raw:string>>, words array<string>"
#: Kinds of flows that may name a declaration of their own file.
INJECTED = ("depends", "parameter")
#: Files whose rows a task holds at once.
TOGETHER = 256


def _schema() -> StructType:
    return _parse_datatype_string(", ".join(x.strip() for x in [INDEX]))


def extract(routed: DataFrame, known: dict[str, str] | None = None, wanted: tuple[str, ...] = PARTS) -> DataFrame:
    """Routed files to index rows; one pass, files independent of each other. known: see ``repo.known_names``.

    Every file is read whole; of the ``PARTS`` of its row only those ``wanted`` leave Python, the others are empty.
    Of symbols the ``names`` or ``places`` may be wanted alone (``model.PARTS``).
    """
    schema = _schema()
    arrow = to_arrow_schema(schema)
    names = () if "symbols" in wanted else PLACES if "places" in wanted else NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, len(b), TOGETHER)):
            texts = batch.column("text").to_pylist()
            found = [packs.extract(pack, kind, file, text, known, wanted) for pack, kind, file, text in zip(*(batch.column(c).to_pylist() for c in ("pack", "source_kind", "file")), texts)]
            made = {
                "text": texts if "text" in wanted else [""] * len(texts),
                "source_hash": [digest(x) for x in texts],
                "fingerprint": [e.fingerprint for e in found],
                "parse_errors": [e.parse_errors for e in found],
                "symbols": _listed([rows(e.symbols, names) if not names or "names" in wanted or "places" in wanted else [] for e in found], arrow.field("symbols").type),
                "imports": _listed([[vars(i) | {"ord": k} for k, i in enumerate(e.imports)] if "imports" in wanted else [] for e in found], arrow.field("imports").type),
                "flows": _listed([[{"ord": k, "kind": kind, "raw": raw} for k, (kind, raw) in enumerate(e.flows)] if "flows" in wanted else [] for e in found], arrow.field("flows").type),
                "words": [e.words if "words" in wanted else [] for e in found],
            }
            columns = [batch.column(f.name).cast(f.type) if f.name not in made else made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return routed.mapInArrow(run, schema)


def _listed(rows_of: list[list[dict]], kind: pa.ListType) -> pa.Array:
    """Each file's rows as one array of structs; fields that no row has are null."""
    flat = list(chain.from_iterable(rows_of))
    ends = pa.array([0, *accumulate(map(len, rows_of))], pa.int32())
    own = list(kind.value_type)
    columns = [pa.array([r[f.name] for r in flat], f.type) if flat and f.name in flat[0] else pa.nulls(len(flat), f.type) for f in own]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=own), type=kind)


@dataclass
class Relations:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    flows: DataFrame
    words: DataFrame
    chased: bool = True  # there may be a re-export
    suffixed: bool = True  # an import may be tried by a path's suffix
    injected: bool = True  # a flow may name a declaration of its own file

    @classmethod
    def staged(cls, index: DataFrame) -> Relations:
        """The relations of an index that is written once, for several joins; what their links need was seen meanwhile."""
        some = lambda test, part="imports": F.max(F.exists(part, test))
        ends = lambda i: F.exists(i.paths, lambda p: p.startswith("*/") | p.startswith("!/"))
        kept, seen = observed(index, chased=some(lambda i: i.form == "reexport"), suffixed=some(ends), injected=some(lambda f: f.kind.isin(*INJECTED), "flows"))
        return replace(cls.of(kept), **{k: bool(v) for k, v in seen.items()})

    @classmethod
    def of(cls, index: DataFrame) -> Relations:
        return cls(
            files=index.select("file", "text", "pack", "source_kind", "role", "source_hash", "fingerprint", "parse_errors"),
            symbols=index.select(F.explode("symbols").alias("s")).select("s.*"),
            imports=index.select(F.col("file").alias("from_file"), F.explode("imports").alias("i")).select("from_file", "i.*"),
            flows=index.select(F.col("file").alias("from_file"), F.explode("flows").alias("f")).select("from_file", "f.*"),
            words=index.select("file", F.explode("words").alias("word")),
        )


def save(index: DataFrame, path: str) -> None:
    index.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, pack: str) -> DataFrame | None:
    """A stored index; None if there is none, or of another version or pack: then it is built anew."""
    from pyspark.errors import AnalysisException

    try:
        index = spark.read.parquet(path)
    except AnalysisException:
        return None
    if "format_version" not in index.columns or not index.where((F.col("format_version") != FORMAT_VERSION) | (F.col("pack") != pack)).isEmpty():
        return None
    return index.drop("format_version")
