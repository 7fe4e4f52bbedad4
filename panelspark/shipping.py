"""Makes this package importable on executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(query: Callable) -> Callable:
    """The query, after the package's source went to the executors, unless PYTHONPATH names its folder."""

    @wraps(query)
    def run(spark, *args):
        context = spark.sparkContext
        if str(_ROOT) not in os.environ.get("PYTHONPATH", "").split(":") and context.applicationId not in _shipped:
            archive = Path(tempfile.mkdtemp(prefix="spark-")) / "panelspark.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for p in sorted((_ROOT / "panelspark").rglob("*.py")):
                    z.write(p, p.relative_to(_ROOT))
            context.addPyFile(str(archive))
            _shipped.add(context.applicationId)
        return query(spark, *args)

    return run
