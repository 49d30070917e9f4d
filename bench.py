"""Times the headline queries once each at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from scoretables.catalog import QUERIES
from scoretables.session import local_session


# One or more of each family; BENCH_ALL=1 times everything.
HEADLINE = [
    "P3_degree_to_pitch", "P6_spell_midi", "P15_overlaps", "T1_punct_score", "T4_script_of", "T5_lyric_tokens", "T12_classify_line", "T14_line_table",
    "A4_quantile_floor", "A8_content_box", "A10_mode_vote", "A11_agree_within", "A21_match_f1", "A22_two_class_split", "A28_top_note", "F3_body_height",
    "J1_resolve_marks", "J2_exact_then_fuzzy", "J3_asof_attr", "J5_overlap_join", "J7_containment_join", "J9_toc_reconcile", "J14_compare_runs",
    "J17_misaligned_onsets", "W1_carry_attr", "W2_running_onset", "W6_clamped_depth", "W7_merge_ties", "W11_gap_cluster_abs", "W14_run_collapse",
    "W17_beat_check", "W18_head_fingerprint", "W23_trim_overlaps", "W24_pair_on_off", "W27_max_concurrency", "W34_beam_groups", "X2_build_timeline",
    "X3_repeat_passes", "X10_axis_slots", "X13_transpose_corpus", "O1_worst_k", "S2_ingest_musicxml", "S7_incremental_apply",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    spark = local_session("scoretables-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, fn in QUERIES.items():
        if only:
            if not any(name.startswith(o) for o in only):
                continue
        elif name not in HEADLINE and not os.environ.get("BENCH_ALL"):
            continue
        t0 = time.perf_counter()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        if only:
            print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
