"""Image sets in their published binary layouts, as ``(id, x, y)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradframe.functions import vec
from gradframe.sources.fixedrecord import decode, read_records

# fixed values: file names and sizes of the published sets
MNIST = {
    True: ("train-images.idx3-ubyte", "train-labels.idx1-ubyte"),
    False: ("t10k-images.idx3-ubyte", "t10k-labels.idx1-ubyte"),
}
MNIST_PIXELS, IMAGE_HEADER, LABEL_HEADER = 28 * 28, 16, 8
CIFAR_PIXELS = 3 * 32 * 32
CIFAR10 = {True: [f"data_batch_{i}.bin" for i in range(1, 6)], False: ["test_batch.bin"]}
CIFAR100 = {True: ["train.bin"], False: ["test.bin"]}


def mnist(
    spark: SparkSession, folder: str, train: bool = True, signed: bool = False, first: int = 0
) -> DataFrame:
    """Images joined with their labels on the record number."""
    image_file, label_file = MNIST[train]
    pixel = "i1" if signed else "u1"
    images = decode(
        read_records(spark, f"{folder}/{image_file}", MNIST_PIXELS, IMAGE_HEADER),
        {"x": (pixel, MNIST_PIXELS)},
    )
    labels = decode(
        read_records(spark, f"{folder}/{label_file}", 1, LABEL_HEADER), {"label": ("u1", 0)}
    )
    joined = images.select("row", "x").join(labels.select("row", "label"), "row")
    return _rows(joined, F.col("label"), 10, first)


def cifar(
    spark: SparkSession,
    folder: str,
    classes: int = 10,
    train: bool = True,
    signed: bool = False,
    first: int = 0,
) -> DataFrame:
    """10 classes: label, pixels; 100 classes: coarse label, label, pixels."""
    names = (CIFAR10 if classes == 10 else CIFAR100)[train]
    pixel = "i1" if signed else "u1"
    fields = {"coarse": ("u1", 0)} if classes == 100 else {}
    fields |= {"label": ("u1", 0), "x": (pixel, CIFAR_PIXELS)}
    paths = ",".join(f"{folder}/{n}" for n in names)
    records = decode(read_records(spark, paths, CIFAR_PIXELS + len(fields) - 1), fields)
    return _rows(records, F.col("label"), classes, first)


def _rows(df: DataFrame, label: Column, classes: int, first: int) -> DataFrame:
    out = df.select(F.col("row").alias("id"), "x", vec.one_hot(label, classes).alias("y"))
    return out.where(F.col("id") < first) if first else out
