"""The page life-cycle as a pure transition function, shared by batch and stream.

A state is (status, attempts).  ``claim`` only acts on pending pages and fails a page
whose attempts are used up; ``done`` and ``error`` are final words of a worker and act
on any state; ``retry`` acts on any page that is not done; ``reap`` frees a stale claim.
"""

from __future__ import annotations

PENDING, RUNNING, DONE, FAILED = "pending", "ocr_running", "ocr_done", "ocr_failed"
MAX_ATTEMPTS = 3
STALE_SECONDS = 600

# (status, attempts, claim_known, claimed_by, claimed_at, error_known, error)
# ``*_known`` tells whether the value was set since the entry of a run.
START = (PENDING, 0, False, None, None, False, None)


def advance(state: tuple, event: str, worker, error, ts, reset_attempts: bool = True) -> tuple:
    status, attempts, claim_known, by, at, error_known, err = state
    if event == "claim":
        if status != PENDING:
            return state
        if attempts >= MAX_ATTEMPTS:
            return (FAILED, attempts, claim_known, by, at, error_known, err)
        return (RUNNING, attempts + 1, True, worker, ts, error_known, err)
    if event == "done":
        return (DONE, attempts, claim_known, by, at, True, None)
    if event == "error":
        status = FAILED if attempts >= MAX_ATTEMPTS else PENDING
        return (status, attempts, True, None, None, True, error)
    if event == "retry":
        if status == DONE:
            return state
        return (PENDING, 0 if reset_attempts else attempts, claim_known, by, at, True, None)
    if event == "reap":
        if status != RUNNING:
            return state
        return (PENDING, attempts, True, None, None, error_known, err)
    return state


def entries() -> list[tuple]:
    """Every state a run of events may be entered in."""
    return [
        (status, attempts, False, None, None, False, None)
        for status in (PENDING, RUNNING, DONE, FAILED)
        for attempts in range(MAX_ATTEMPTS + 1)
    ]
