"""Reading and writing fields: Parquet, raw table files, and descriptors for viewers."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.layout import AXES, normalise
from gridloom.plans.spec import GridSpec


def write_field(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """Store a field or spectrum as Parquet, by component; ``single`` stores 32-bit values."""
    values = [c for c in ("v", "re", "im") if c in df.columns]
    kind = "float" if single else "double"
    df.withColumns({c: F.col(c).cast(kind) for c in values}).write.mode(mode).partitionBy("comp").parquet(path)


def read_field(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    values = [c for c in ("v", "re", "im") if c in df.columns]
    keys = [(F.col(k) if k in df.columns else F.lit(0)).cast("long" if k == "rhs_id" else "int").alias(k) for k in ("rhs_id", "comp", *AXES)]
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in values))


def read_raw(spark: SparkSession, path: str, shape: tuple[int, int, int], order: str = "little") -> DataFrame:
    """A raw file of doubles, first axis fastest, as a field."""
    kind, n = ("<f8" if order == "little" else ">f8"), shape[0] * shape[1] * shape[2]

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content"):
                v = np.frombuffer(content.as_py(), kind).astype(float)
                if len(v) != n:
                    raise ValueError(f"{len(v)} values, not {n}")
                i = np.arange(n)
                cols = [np.zeros(n, np.int64), np.zeros(n, np.int32), i % shape[0], i // shape[0] % shape[1], i // (shape[0] * shape[1]), v]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rhs_id", "comp", *AXES, "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "rhs_id long, comp int, i0 int, i1 int, i2 int, v double")


def descriptor(grid: GridSpec, name: str, path: str, components: int = 1) -> str:
    """XML description of a stored field for viewers: size, origin, spacing and attribute."""
    n = grid.shape
    dims = f"{n[2]} {n[1]} {n[0]}"
    h = [x or 1.0 for x in grid.h]
    kind = "Vector" if components == 3 else "Scalar"
    return (
        '<?xml version="1.0"?>\n<Xdmf Version="3.0"><Domain><Grid Name=' + quoteattr(name) + ' GridType="Uniform">\n'
        f'<Topology TopologyType="3DCoRectMesh" Dimensions="{dims}"/>\n<Geometry GeometryType="ORIGIN_DXDYDZ">'
        '<DataItem Dimensions="3" Format="XML">0 0 0</DataItem>'
        f'<DataItem Dimensions="3" Format="XML">{h[2]} {h[1]} {h[0]}</DataItem></Geometry>\n'
        f"<Attribute Name={quoteattr(name)} AttributeType=\"{kind}\" Center=\"Node\"><Information Name=\"parquet\" Value={quoteattr(path)}/></Attribute>\n"
        "</Grid></Domain></Xdmf>\n"
    )


def provenance(spark: SparkSession) -> str:
    """JSON of the versions and settings behind a result."""
    conf = dict(spark.sparkContext.getConf().getAll())
    keep = {k: v for k, v in conf.items() if k.startswith(("spark.sql.", "spark.executor.", "spark.master", "spark.driver.memory"))}
    return json.dumps({"spark": spark.version, "conf": keep}, sort_keys=True)


def show(df: DataFrame, n: int = 20) -> None:
    """Print the first points of a field in index order."""
    normalise(df).orderBy("rhs_id", "comp", *reversed(AXES)).show(n)
