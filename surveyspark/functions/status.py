"""Gender and activity status: who works, who seeks work, and which job describes a worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyspark import codebook as cb


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def report_gender_code(original: str = "Gender_original") -> Column:
    """Reports fold code 3 into code 1; the original column stays beside this one."""
    return F.when(F.col(original) == "3", "1").otherwise(F.col(original))


def gender_name(code: Column) -> Column:
    return F.when(code == "1", "Male").when(code == "2", "Female")


def principal_worker(principal: str = "Principal_status") -> Column:
    return _is(F.col(principal).isin(*cb.WORK_CODES))


def subsidiary_worker(subsidiary: str = "Subsidiary_status") -> Column:
    return _is(F.col(subsidiary).isin(*cb.WORK_CODES))


def activity_flags(principal: str = "Principal_status", subsidiary: str = "Subsidiary_status") -> dict[str, Column]:
    """Usual status: work in either job makes a worker, also for those who seek work mainly."""
    worker = principal_worker(principal) | subsidiary_worker(subsidiary)
    seeking = _is(F.col(principal) == cb.SEEKING_CODE)
    return {"Worker": worker, "Labour_force": worker | seeking, "Unemployed": seeking & ~worker}


def range_flags(principal: str, subsidiary: str) -> dict[str, Column]:
    """Historical flags by code range, for each status apart and combined.

    A principal status outside the ranges leaves its own flag NULL; a missing one makes it 0.
    """
    p, s = F.col(principal), F.col(subsidiary)
    labour_ps = F.when(p.between(11, 51) | (p == 81), 1).when(p.isNull(), 0)
    labour_ss = F.when(s.between(11, 51), 1).when(s.isNull(), 0)
    work_ps = F.when(p.between(11, 51), 1).when(p.isNull(), 0)
    return {
        "labour_force_ps": labour_ps,
        "labour_force_ss": labour_ss,
        "Labour_force": (_is(labour_ps == 1) | _is(labour_ss == 1)).cast("int"),
        "worker_ps": work_ps,
        "worker_ss": labour_ss,
        "Worker": (_is(work_ps == 1) | _is(labour_ss == 1)).cast("int"),
    }


def selected_job(principal_detail: str, subsidiary_detail: str,
                 principal: str = "Principal_status", subsidiary: str = "Subsidiary_status") -> Column:
    """Detail of the job that describes the worker.

    The principal job if the person works there, else the subsidiary job.  A blank detail of the
    chosen job stays blank.
    """
    return F.when(principal_worker(principal), F.col(principal_detail)).when(
        subsidiary_worker(subsidiary), F.col(subsidiary_detail))


def first_nonblank(principal_detail: str, subsidiary_detail: str) -> Column:
    """Historical rule: the principal detail, or the subsidiary one where that is blank."""
    return F.coalesce(F.nullif(F.col(principal_detail), F.lit("")), F.nullif(F.col(subsidiary_detail), F.lit("")))


def broad_status(status: Column | str) -> Column:
    """Four employment types from an activity code; NULL for a code that is not work."""
    status = F.col(status) if isinstance(status, str) else status
    pairs = [F.lit(v) for pair in cb.BROAD_STATUS.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), status.cast("int"))


def cascaded_broad_status(principal: str = "Principal_status", subsidiary: str = "Subsidiary_status") -> Column:
    """Historical rule: type from the principal code, else from the subsidiary code."""
    return F.coalesce(broad_status(principal), broad_status(subsidiary))
