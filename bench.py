"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores). The text tables are first
written again as folders of part files, as large tables are, so that scans use all
cores; that isn't timed. Every query
runs once to warm up, then BENCH_RUNS times; the median counts. Results go to
the no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from veilspan.operators import audit, redact, restore  # noqa: E402
from veilspan.operators.detect import with_regex_spans  # noqa: E402
from veilspan.operators.merge import merge_spans  # noqa: E402
from veilspan.plans import common, entities, redaction, routes  # noqa: E402
from veilspan.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def headline():
    """name -> (query, input whose rows are counted)."""
    forms, docs = common.forms, common.documents
    return {
        "spans_of_documents": (lambda s, d: with_regex_spans(docs(s, d)), docs),
        "spans_of_forms": (lambda s, d: with_regex_spans(forms(s, d)), forms),
        "redact_documents": (lambda s, d: common.redacted(docs(s, d)), docs),
        "redact_forms": (lambda s, d: common.redacted(forms(s, d)), forms),
        "redact_forms_ordinal": (redaction.ordinal_redacted, forms),
        "restore_forms": (lambda s, d: restore.restore(
            redact.with_mappings(common.redacted(forms(s, d))), text_col="sanitized"), forms),
        "merge_forms_safe": (common.merged, forms),
        "merge_forms_anti_join": (lambda s, d: merge_spans(
            entities.long_regex(s, d), entities.long_ner(s, d)), forms),
        "route_documents": (routes.by_rules(docs), docs),
        "density_of_documents": (lambda s, d: audit.density(
            with_regex_spans(docs(s, d)), "lang", "source"), docs),
        "session_mappings": (lambda s, d: redact.assign_synthetic(
            redaction.spans(s, d), salt=common.QUERY_SALT), forms),
    }


def in_parts(spark, folder: str, to: str) -> str:
    """The tables that queries read, each as a folder of part files."""
    for name in ("documents", "customer", "events", "conversations", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(2 * int(CPUS)).write.parquet(
            f"{to}/{name}.parquet")
    return to


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    scratch = tempfile.TemporaryDirectory()
    folder = in_parts(spark, FOLDER, scratch.name)
    for name, (query, source) in headline().items():
        run(query(spark, folder))
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            df = query(spark, folder)
            built = time.perf_counter() - start
            times.append(built + run(df))
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
        seconds[name] = round(statistics.median(times), 3)
        rates[name] = round(source(spark, folder).count() / seconds[name])
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "texts_per_sec": rates,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
