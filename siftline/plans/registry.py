"""Collects the registered queries of the reference's own operators."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

#: Modules of this package that hold ``QUERIES`` and ``ORACLES``.
MODULES: list[str] = ["corpus", "evaluation", "texts", "choosing", "dialogue", "building", "recording", "arms", "files", "authoring"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"siftline.plans.{name}"), attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        out |= part
    return out


#: Columns that one engine gives another integer width: both sides cast them to 64 bits.
WIDE = {
    "decontam_longest_run": "start leaf run", "normalized_tokens": "n_tokens", "corpus_profile": "est_tokens max_chars", "corpus_profile_rollup": "chars", "drop_reason_cascade": "chars",
    "reconciliation": "n_read n_kept n_dropped", "describe": "min max", "index_percentile": "p50 p90 p95 p99", "weighted_nll": "n_tok", "benchmark_aggregate": "n", "expert_scores": "expert",
    "text_shapes": "chars paragraphs bullets", "roundrobin_interleave": "position", "sidecar_join": "chars", "worker_split": "ids", "replay_mix": "ids", "conv_normalize": "n", "conv_preamble": "n",
    "conv_first_assistant": "n", "conv_render": "own_chars n_spans", "trace_messages": "n n_calls",
}


def _widened(name: str, query):
    if name not in WIDE:
        return query

    @wraps(query)
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("bigint") for c in WIDE[name].split()})

    return run


def queries() -> dict:
    return {name: _widened(name, query) for name, query in _merged("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    out = _merged("ORACLES")
    for name, columns in WIDE.items():
        casts = ", ".join(f'"{c}"::BIGINT AS "{c}"' for c in columns.split())
        out[name] = f"SELECT * REPLACE ({casts}) FROM ({out[name]})"
    return out
