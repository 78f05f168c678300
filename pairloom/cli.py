"""Command line: ``python -m pairloom.cli curate|extract|fasta|cluster``."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairloom.operators.clustering import IDENTITY
from pairloom.operators.fasta import fasta_records, group_sequences, several_clusters, write_fasta
from pairloom.plans import curation
from pairloom.schemas import CANDIDATES, SEQUENCES
from pairloom.session import clean, stage
from pairloom.sources import archive
from pairloom.sources.mmcif import read_structures
from pairloom.sources.tsv import read_tsv, write_tsv

log = logging.getLogger("pairloom")


def _curate(spark: SparkSession, o: argparse.Namespace) -> None:
    if o.documents:
        docs = curation.load(spark, o.documents)
    else:
        if not (o.search_url and o.metadata_url):
            raise SystemExit("--documents, or --search-url and --metadata-url, must be given")
        if o.limit < 0:
            raise SystemExit("--limit must not be negative")
        ids = stage(archive.distinct_ids(archive.search_ids(spark, o.search_url, o.no_ligands)), "ids")
        log.info("%d assemblies found", ids.count())
        batched = archive.batches(archive.limit_ids(ids, o.limit), o.batch_size)
        docs = stage(archive.fetch_documents(batched, o.metadata_url), "documents")
    out = curation.curate(docs, files_base=o.files_base)
    for name, rows in (("all_candidate_assemblies", out.candidates), ("selected_assemblies", out.selected)):
        write_tsv(rows.drop("entity_clusters").orderBy("pdb_id", "assembly_number"), f"{o.outdir}/{name}.tsv", one_file=o.one_file)
        rows.write.parquet(f"{o.outdir}/{name}.parquet")
    out.rejects.write.parquet(f"{o.outdir}/rejects.parquet")
    log.info("%d candidates, %d selected, %d rejected", out.candidates.count(), out.selected.count(), out.rejects.count())
    if o.download:
        files = spark.createDataFrame([], "file string, size long")
        try:
            files = archive.listed_files(spark, f"{o.outdir}/assemblies")
            files.limit(1).collect()
        except Exception as e:  # the folder isn't there yet
            log.info("no files yet: %s", type(e).__name__)
            files = spark.createDataFrame([], "file string, size long")
        archive.download_files(archive.missing_files(out.selected, files), f"{o.outdir}/assemblies")


def _selected(spark: SparkSession, path: str):
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_tsv(spark, path, CANDIDATES)


def _extract(spark: SparkSession, o: argparse.Namespace) -> None:
    rows = curation.sequences(_selected(spark, o.selected), read_structures(spark, o.structures), aligned=o.aligned)
    write_tsv(rows.orderBy("entity_name"), o.out, one_file=o.one_file, line_end="\n")


def _fasta(spark: SparkSession, o: argparse.Namespace) -> None:
    rows = stage(read_tsv(spark, o.sequences, SEQUENCES).withColumn("ord", F.monotonically_increasing_id()), "sequences")
    groups = group_sequences(rows, "ord", drop_missing=o.drop_missing)
    log.warning("%d sequences stand in several clusters", several_clusters(groups).count())
    write_fasta(fasta_records(groups), o.out, one_file=o.one_file)


def _cluster(spark: SparkSession, o: argparse.Namespace) -> None:
    curation.clusters(read_tsv(spark, o.sequences, SEQUENCES), o.identity).write.parquet(o.out)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(message)s")
    p = argparse.ArgumentParser(prog="pairloom")
    p.add_argument("--conf", type=json.loads, default={}, help="Spark settings as a JSON object")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("curate")
    c.set_defaults(run=_curate)
    c.add_argument("--documents", help="landed documents, one JSON text a line")
    c.add_argument("--search-url")
    c.add_argument("--metadata-url")
    c.add_argument("--files-base", default="")
    c.add_argument("--outdir", required=True)
    c.add_argument("--batch-size", type=int, default=200)
    c.add_argument("--no-ligands", action="store_true")
    c.add_argument("--no-download", dest="download", action="store_false")
    c.add_argument("--limit", type=int, default=0)
    e = sub.add_parser("extract")
    e.set_defaults(run=_extract)
    e.add_argument("--selected", required=True)
    e.add_argument("--structures", required=True)
    e.add_argument("--aligned", action="store_true")
    f = sub.add_parser("fasta")
    f.set_defaults(run=_fasta)
    f.add_argument("--drop-missing", action="store_true")
    k = sub.add_parser("cluster")
    k.set_defaults(run=_cluster)
    k.add_argument("--identity", type=float, default=IDENTITY)
    for x in (e, f, k):
        x.add_argument("--out", required=True)
    for x in (f, k):
        x.add_argument("--sequences", required=True)
    for x in (c, e, f):
        x.add_argument("--one-file", action="store_true", help="a single part; for small tables")
    o = p.parse_args(args)
    own = spark or SparkSession.builder.appName("pairloom").config(map=o.conf).getOrCreate()
    try:
        o.run(own, o)
    finally:
        clean(own)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
