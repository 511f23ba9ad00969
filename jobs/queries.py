"""The jobs as queries: each runs its function twice over the whole tables into one new folder, and returns what stands there."""

from __future__ import annotations

import uuid

from pointloom.plans.registry import DECIDED
from pointloom.session import scratch_root

from . import decide_frames, session_journal

#: Two recordings have roles of their own, the others are for development; the locked one is left alone.
DECIDE = decide_frames.DEFAULTS | {"role_of_recording": {"NATION_7": "validation", "NATION_12": "locked_test"}}


def _folder(spark, name: str) -> str:
    """A new folder that stays."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_decide_frames(spark, sf_dir):
    out = _folder(spark, "job1")
    for _ in range(2):
        decide_frames.run(spark, *[f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation")], f"{out}/output", DECIDE)
    return decide_frames.output(spark, f"{out}/output")


def job2_session_journal(spark, sf_dir):
    out = _folder(spark, "job2")
    for _ in range(2):
        session_journal.run(spark, f"{sf_dir}/conversations.parquet*", f"{out}/output", f"{out}/checkpoint")
    return session_journal.output(spark, f"{out}/output")


DECIDE_SQL = f"""
with cards as (with recursive {DECIDED}),
named as (select c.*, n_name as recording, case n_name when 'NATION_7' then 'validation' when 'NATION_12' then 'locked_test' else 'development' end as role,
  '{decide_frames.identity(DECIDE)}' as identity from cards c join supplier on s_suppkey = frame_index join nation on n_nationkey = s_nationkey)
select *, count(*) over r as frames, count(*) filter (decision = 'conditional_intrusion') over r as intruded, count(*) filter (decision = 'insufficient_evidence') over r as
  undecided, min(nearest_intrusion_m) over r as nearest_m from named where role <> 'locked_test' window r as (partition by recording)
"""
JOURNAL_SQL = """
with r as (select distinct conv_id as session_id, turn as sequence, role as topic, length(text) as chars, substring(sha256(text), 1, 16) as digest from conversations),
s as (select session_id, count(*) as messages, min(sequence) as first_sequence, max(sequence) as last_sequence, coalesce(max(sequence) - min(sequence) + 1 - count(distinct sequence), 0) as
  missing, count(sequence) - count(distinct sequence) as conflicting, count(distinct coalesce(topic, '')) as topics, sum(coalesce(chars, 0))::bigint as chars_sent from r group by session_id)
select r.*, s.* exclude (session_id) from r join s on s.session_id is not distinct from r.session_id
"""


def queries() -> dict:
    return {"job1_decide_frames": job1_decide_frames, "job2_session_journal": job2_session_journal}


def oracle_sql() -> dict[str, str]:
    return {"job1_decide_frames": DECIDE_SQL, "job2_session_journal": JOURNAL_SQL}
