"""Reading and writing tensors, models' configurations and dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec

#: A configuration's fields, the names that each may have (the first found counts), and what holds without any.
CONFIG = {
    "n_vocab": (("vocab_size",), 32000), "n_embd": (("hidden_size", "dim"), 4096), "n_head": (("num_attention_heads", "n_heads"), 32),
    "n_head_kv": (("num_key_value_heads", "n_kv_heads"), "n_head"), "n_layer": (("num_hidden_layers", "n_layers"), 32),
    "n_ff": (("intermediate_size", "hidden_dim"), "4 * n_embd"), "n_ctx": (("max_position_embeddings", "max_seq_len"), 32768),
    "rope_theta": (("rope_theta",), 10000.0), "rms_norm_eps": (("rms_norm_eps", "norm_eps"), 1e-5),
}
#: Parts of tensor names, and the weight they stand for.
NAMES = {
    "q_proj": "wq", "k_proj": "wk", "v_proj": "wv", "o_proj": "wo", "gate_proj": "w_gate", "up_proj": "w_up", "down_proj": "w_down", "lm_head": "output_proj",
    "input_layernorm": "attn_norm", "post_attention_layernorm": "ffn_norm", "embed_tokens": "embedding", "model.norm": "output_norm",
}


def config_of(raw: DataFrame) -> DataFrame:
    """A row of settings for each row of raw (value: the text of a config.json)."""
    get = lambda n: F.get_json_object("value", f"$.{n}").cast("double")
    found = {c: F.coalesce(*map(get, names)) for c, (names, _) in CONFIG.items()}
    made = {c: F.lit(float(rest)) for c, (_, rest) in CONFIG.items() if not isinstance(rest, str)}
    made["n_head_kv"] = F.coalesce(found["n_head"], made["n_head"])
    made["n_ff"] = 4 * F.coalesce(found["n_embd"], made["n_embd"])
    kind = lambda c: "double" if c in ("rope_theta", "rms_norm_eps") else "int"
    return raw.select(*(F.coalesce(found[c], made[c]).cast(kind(c)).alias(c) for c in CONFIG))


def model_config(spark: SparkSession, path: str) -> DataFrame:
    """One row of a config.json."""
    return config_of(spark.read.text(path, wholetext=True))


def weight_name(name) -> F.Column:
    """The weight that a tensor's name stands for; null for others."""
    out = F.lit(None).cast("string")
    for part, short in NAMES.items():
        out = F.when(name.contains(part), short).otherwise(out)
    return out


def layer_of(name) -> F.Column:
    """The number after 'layers.' in a tensor's name; null without."""
    return F.nullif(F.regexp_extract(name, r"layers\.([0-9]+)\.", 1), F.lit("")).cast("int")


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of raw files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def bf16_values(files: DataFrame) -> DataFrame:
    """path, i, bits of raw little-endian bfloat16 files."""
    pairs = F.regexp_extract_all(F.hex("content"), F.lit("(....)"), F.lit(1))
    at = files.select("path", F.posexplode(pairs).alias("i", "h"))
    return at.select("path", "i", F.conv(F.concat(F.substring("h", 3, 2), F.substring("h", 1, 2)), 16, 10).cast("long").alias("bits"))


def save_packed(elements: DataFrame, path: str) -> None:
    """Compresses and writes packed rows and patches, by tensor."""
    rows, patches = codec.encode(elements)
    rows.write.mode("overwrite").partitionBy("tensor").parquet(f"{path}/rows")
    patches.write.mode("overwrite").partitionBy("tensor").parquet(f"{path}/patches")


def load_packed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    kinds = "r long, n int, base_exp int, sm binary, gr binary, tensor string", "r long, k long, correct long, wrong long, tensor string"
    return tuple(spark.read.schema(k).parquet(f"{path}/{t}") for k, t in zip(kinds, ("rows", "patches"), strict=True))


def save_raw(elements: DataFrame, path: str) -> None:
    """Writes each row of a tensor as little-endian bfloat16 bytes: tensor, r, n, raw."""
    two = lambda b: F.concat(*(F.lpad(F.hex(x), 2, "0") for x in (b.bitwiseAND(F.lit(255)), F.shiftright(b, 8))))
    cells = codec.with_bits(elements).groupBy("tensor", "r").agg(F.array_sort(F.collect_list(F.struct("k", "bits"))).alias("a"))
    raw = F.unhex(F.array_join(F.transform("a", lambda x: two(x["bits"])), ""))
    cells.select("tensor", "r", F.size("a").alias("n"), raw.alias("raw")).write.mode("overwrite").partitionBy("tensor").parquet(path)


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """tensor, r, k, bits of what save_raw wrote."""
    rows = spark.read.schema("r long, n int, raw binary, tensor string").parquet(path)
    pairs = F.regexp_extract_all(F.hex("raw"), F.lit("(....)"), F.lit(1))
    at = rows.select("tensor", "r", F.posexplode(pairs).alias("k", "h"))
    return at.select("tensor", "r", F.col("k").cast("long").alias("k"), F.conv(F.concat(F.substring("h", 3, 2), F.substring("h", 1, 2)), 16, 10).cast("long").alias("bits"))


#: The element types of a safetensors file that are read.
KINDS = {"F32": "<f4", "F16": "<f2", "BF16": "<u2"}


def safetensors(spark: SparkSession, path: str) -> DataFrame:
    """name, r, vals (array of float): the rows of every tensor of a folder's *.safetensors files of one or two dimensions.

    A tensor that several files have is the last file's, by name. A file is read by one task as a whole, so files are at
    most 2 GB each, which is what shards are made for; tensors of other types are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path).select("path", "content")

    def rows(batches):
        import json

        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(raw.as_buffer())
                size = int.from_bytes(data[:8], "little")
                for name, t in json.loads(bytes(data[8 : 8 + size])).items():
                    if name == "__metadata__" or t["dtype"] not in KINDS or not 1 <= len(t["shape"]) <= 2:
                        continue
                    a, z = (8 + size + x for x in t["data_offsets"])
                    x = np.frombuffer(data[a:z], KINDS[t["dtype"]])
                    x = (x.astype("u4") << 16).view("f4") if t["dtype"] == "BF16" else x.astype("f4")
                    x = x.reshape(-1, t["shape"][-1]) if t["shape"][-1] else x.reshape(0, 0)
                    for r in range(0, len(x), 1024):
                        part = x[r : r + 1024]
                        vals = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                        n = len(part)
                        yield pa.record_batch([pa.array([at] * n), pa.array([name] * n), pa.array(np.arange(r, r + n)), vals], ["path", "name", "r", "vals"])

    found = files.mapInArrow(rows, "path string, name string, r long, vals array<float>")
    # From the names alone; there are some hundreds.
    last = found.groupBy("name").agg(F.max("path").alias("path"))
    return found.join(F.broadcast(last), ["name", "path"]).select("name", "r", "vals")


def elements_of(rows: DataFrame) -> DataFrame:
    """tensor, layer, r, k, v of rows of named tensors that stand for a weight."""
    own = rows.select(weight_name(F.col("name")).alias("tensor"), layer_of(F.col("name")).alias("layer"), "r", F.posexplode("vals").alias("k", "v"))
    return own.filter("tensor is not null").select("tensor", "layer", "r", F.col("k").cast("long").alias("k"), "v")


def convert(spark: SparkSession, source: str, target: str) -> None:
    """A folder of safetensors files and a config.json, compressed: rows and patches by tensor and layer ('wq.0'), settings."""
    el = elements_of(safetensors(spark, source))
    name = F.concat_ws(".", "tensor", F.col("layer").cast("string"))
    save_packed(el.select(name.alias("tensor"), "r", "k", "v"), target)
    model_config(spark, f"{source}/config.json").write.mode("overwrite").parquet(f"{target}/config")


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """config, and weights (tensor, layer, r, k, v), decoded exactly, of what convert wrote."""
    back = codec.decode(*load_packed(spark, path))
    part = F.split("tensor", r"\.")
    weights = back.select(part[0].alias("tensor"), F.get(part, F.lit(1)).cast("int").alias("layer"), "r", "k", "v")
    return {"config": spark.read.parquet(f"{path}/config"), "weights": weights}
