"""Contributions of files as keyed state: edits and removals of files move through a stream as changes.

The state holds what each file contributes. An event with a text replaces that, one without a text takes it back; what goes
out is only the difference, so that the sum of all changes is at any time what a fresh run over the present files gives. An
event whose text is known changes nothing and extracts nothing.

Files share keys by a hash of their path, since each key is a call of Python: a key's state is a map of its files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "repo_key string, path string, value string, delta int"
_STATE = "held string"
#: Keys of the state in each repository. A batch reads and writes the whole maps of the keys that its events fall on.
BUCKETS = 4096


def changes(events: DataFrame, extract: Callable[[str, str], list[str]], keep_for: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(repo_key, path, value, delta) of a stream of events (repo_key, path, text, seq): +1 for what a file newly
    contributes, -1 for what it no longer does. ``extract`` gives the distinct contributions of (path, text) as strings.

    Of a file's events in one batch the one of highest ``seq`` counts. With ``keep_for`` (an interval), a file that has had no
    event for so long counts as removed. ``buckets`` stays what it was when the stream began.
    """
    milliseconds = int(pd.Timedelta(keep_for).total_seconds() * 1000) if keep_for else 0

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each file the hash of its text, its contributions, and when it had its last event
        files: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        now, last = state.getCurrentProcessingTimeMs(), {}
        for b in () if state.hasTimedOut else batches:
            for path, seq, text in zip(b["path"], b["seq"], b["text"], strict=True):
                if path not in last or seq > last[path][0]:
                    last[path] = (seq, text)
        if milliseconds:
            last |= {path: (0, None) for path, (_, _, at) in files.items() if path not in last and at + milliseconds <= now}
        rows = []
        for path, (_, text) in last.items():
            sha, held, _ = files.pop(path, ("", [], 0))
            old, new = set(held), set()
            if text is not None:
                sha_now = hashlib.sha256(text.encode()).hexdigest()
                new = old if sha_now == sha else set(extract(path, text))
                files[path] = [sha_now, sorted(new), now if milliseconds else 0]
            rows += [(key[0], path, v, 1) for v in sorted(new - old)] + [(key[0], path, v, -1) for v in sorted(old - new)]
        if files:
            state.update((json.dumps(files),))
            if milliseconds:
                state.setTimeoutDuration(max(1, min(at for _, _, at in files.values()) + milliseconds - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["repo_key", "path", "value", "delta"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout
    keyed = events.select("repo_key", F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"), "path", "text", "seq")
    return keyed.groupBy("repo_key", "bucket").applyInPandasWithState(update, CHANGES, _STATE, "append", timeout)


def present(written: DataFrame) -> DataFrame:
    """(repo_key, path, value): what the changes written so far leave."""
    return written.groupBy("repo_key", "path", "value").agg(F.sum("delta").alias("n")).where("n > 0").select("repo_key", "path", "value")
