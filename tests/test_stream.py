"""The limiter with timers: decisions of a plain loop over batches and restarts, and state that goes."""

import random
from datetime import UTC, datetime

from codeloom.streaming import token_bucket

EVENTS = "event_id long, ts timestamp, user_id long"


def test_idle_clients_leave_no_state_and_restarts_change_nothing(spark, tmp_path):
    rng, at, event = random.Random(8), 1_700_000_000.0, 0
    rate, burst, bucket, want, states = 1 / 60, 3.0, {}, {}, []
    for run in range(3):
        # each run is a batch: 40 clients at once, then two that go on alone
        for clients, moments in ((range(40), 5), ((1, 2), 6)):
            rows = []
            for client in clients:
                for _ in range(moments):
                    rows.append((event, at + rng.random() * 90, client))
                    event += 1
            at += 900
            times = [(e, datetime.fromtimestamp(t, UTC).replace(tzinfo=None), c) for e, t, c in rows]
            spark.createDataFrame(times, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
            for e, t, c in sorted(rows, key=lambda r: (round(r[1], 6), r[0])):
                tokens, last = bucket.get(c, (burst, t))
                tokens = min(burst, tokens + (t - last) * rate)
                want[str(c), e] = tokens >= 1
                bucket[c] = (tokens - want[str(c), e], t)
        got, rows_of_state = token_bucket.run_with_timers(spark, f"{tmp_path}/events", EVENTS, rate, burst, str(tmp_path / "to"), files=1)
        states.append(rows_of_state)
        assert {(r.client, r.request): r.admitted for r in got.collect()} == want
    assert len(set(want.values())) == 2
    # forty buckets after the large batch, two at most after the small one
    assert all(max(s) >= 40 and s[-1] <= 8 for s in states), states
