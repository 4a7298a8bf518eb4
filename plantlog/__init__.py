"""Asset-event analytics on Spark: one keyed signal log in, every derived table out."""

from plantlog.schema import DEFAULT_VOCABULARY, Vocabulary
from plantlog.session import configure, work_dir

__all__ = ["DEFAULT_VOCABULARY", "Vocabulary", "configure", "work_dir"]
