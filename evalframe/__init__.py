"""evalframe: evaluation analytics for prompts and models as Spark table work.

Examples, candidates, model responses and run logs are keyed DataFrames; every
operator takes DataFrames and returns a DataFrame, column helpers return Columns.
"""

from evalframe.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
