"""Profile, suggest, run, verify, and follow up on what is still open."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .profile import profile
from .recipe import RecipeRun, run_recipe
from .suggest import collect_steps, suggest_steps
from .verify import OPEN_VERDICTS, follow_up_steps, verify_profiles


@dataclass
class CleanResult:
    df: DataFrame                 # the cleaned table, read from its written copy
    before: DataFrame             # profiles
    after: DataFrame
    verdicts: DataFrame
    rounds: list[RecipeRun] = field(default_factory=list)

    @property
    def steps(self) -> list[dict]:
        return [r.step for run in self.rounds for r in run.runs]

    def release(self) -> None:
        """Delete the intermediate tables; the result itself stays."""
        for run in self.rounds:
            run.release()

    def n_open(self) -> int:
        return self.verdicts.filter(F.col("verdict").isin(OPEN_VERDICTS)).count()


def auto_clean(df: DataFrame, max_rounds: int = 2, columns: list[str] | None = None,
               approximate: bool = False) -> CleanResult:
    """Clean a table by the steps its own profile calls for.

    Every round's result is written once; its profile and the next round read
    that copy.
    """
    before = profile(df, approximate)
    steps = collect_steps(suggest_steps(before, columns))
    current, after, rounds = df, before, []
    verdicts = verify_profiles(before, after)
    while steps and len(rounds) < max_rounds:
        run = run_recipe(current, steps)
        rounds.append(run)
        current = stage(run.df, "cleaned")
        after = profile(current, approximate)
        verdicts = verify_profiles(before, after)
        steps = collect_steps(follow_up_steps(verdicts, after))
    return CleanResult(current, before, after, verdicts, rounds)
