"""Dumps of nodes, edges and matrices, as text or binary."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raywalk.sources.series import store_of


def write_nodes(nodes: DataFrame, path: str) -> None:
    """``{segment_node} distance`` for each line, in order."""
    line = F.format_string("{%d_%d} %s", "segment", "node", F.col("radius").cast("string"))
    nodes.orderBy("segment", "node").select(line).write.mode("overwrite").text(path)


def parse_nodes(lines: DataFrame) -> DataFrame:
    """``segment``, ``node``, ``radius`` from lines in column ``value``; other lines are skipped."""
    pattern = r"^\{(\d+)_(\d+)\}\s+(\S+)\s*$"
    part = [F.regexp_extract("value", pattern, k) for k in (1, 2, 3)]
    return lines.where(F.col("value").rlike(pattern)).select(part[0].cast("int").alias("segment"), part[1].cast("int").alias("node"), part[2].cast("double").alias("radius"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return parse_nodes(spark.read.text(path))


def write_edges(edges: DataFrame, path: str) -> None:
    """``{a_b} -[weight]-> {c_d}`` for each line, in order."""
    line = F.format_string("{%d_%d} -[%d]-> {%d_%d}", "from_segment", "from_node", "weight", "to_segment", "to_node")
    edges.orderBy("from_segment", "from_node", "to_segment", "to_node").select(line).write.mode("overwrite").text(path)


def format_matrix(matrix: np.ndarray) -> str:
    """``rows x cols``, an empty line, tab-separated rows."""
    return f"{matrix.shape[0]} x {matrix.shape[1]}\n\n" + "".join("\t".join(repr(float(v)) for v in row) + "\n" for row in matrix)


def parse_matrix(text: str) -> np.ndarray:
    head, _, body = text.partition("\n\n")
    rows, cols = (int(x) for x in head.split("x"))
    values = np.array([float(v) for line in body.splitlines() if line.strip() for v in line.split("\t") if v.strip()])
    if len(values) != rows * cols:
        raise ValueError(f"{rows} x {cols} values are announced, {len(values)} are there")
    return values.reshape(rows, cols)


def pack_matrix(matrix: np.ndarray) -> bytes:
    """Big-endian int64 rows and columns, then float64 row by row."""
    return np.array(matrix.shape, ">i8").tobytes() + matrix.astype(">f8").tobytes()


def unpack_matrix(data: bytes) -> np.ndarray:
    rows, cols = np.frombuffer(data[:16], ">i8").tolist()
    if len(data) != 16 + 8 * rows * cols:
        raise ValueError("the size doesn't fit the header")
    return np.frombuffer(data[16:], ">f8").astype(float).reshape(rows, cols)


def write_matrix(matrix: np.ndarray, path: str, binary: bool = False) -> None:
    """One file, as text or binary; its folder is made if need be."""
    store, at = store_of(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(pack_matrix(matrix) if binary else format_matrix(matrix).encode())


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``row``, ``col``, ``value`` of a dump of either kind; a driver-side matrix, such as a covariance or a rotation."""
    store, at = store_of(path)
    with store.open_input_stream(at) as f:
        data = f.read()
    matrix = parse_matrix(data.decode()) if data[:1].isdigit() else unpack_matrix(data)
    return spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])], "row int, col int, value double")
