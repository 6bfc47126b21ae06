"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom.operators import encode as E
from wordloom.operators.tokenizer import Tokenizer
from wordloom.plans import catalog
from wordloom.sources.model_file import parse_model
from wordloom.sources.tables import read_table, spread

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("e_tokens_by_lang", "a4_unigram", "a10_bpe", "n1_normalize", "w5_metaspace_split", "p1_padding", "t2_truncation_special", "m1_merge", "c_index_mapping", "d1_decode", "x2_stream_decode")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in QUERIES:
        start = time.time()
        catalog.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    start = time.time()
    tokens = catalog.e_tokens_by_lang(spark, SF_DIR).agg(F.sum("tokens")).first()[0]
    warm = time.time() - start
    out = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR).removeprefix("sf"), "tokens": tokens, "tokens_per_sec_warm": round(tokens / warm)}
    print(json.dumps(out | large_vocabulary(spark)))


def large_vocabulary(spark: SparkSession) -> dict:
    """A public vocabulary of 32,000 pieces, where it is installed: loading, and ids of every whole text, first and warm."""
    try:
        import public_tokenizers
    except ImportError:
        return {}
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        start = time.time()
        tok = Tokenizer.from_model(parse_model(f.read()))
        out = {"load_32k_ms": round(1000 * (time.time() - start))}
    docs = spread(read_table(spark, SF_DIR, "documents").select("text"))
    for run in ("first", "warm"):
        start = time.time()
        n = docs.agg(F.sum(F.size(E.token_ids("text", tok, False)))).first()[0]
        out[f"tokens_per_sec_32k_whole_texts_{run}"] = round(n / (time.time() - start))
    return out


if __name__ == "__main__":
    main()
