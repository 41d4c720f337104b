"""keepsake: a PySpark engine for long-lived knowledge stores."""

from __future__ import annotations

import os
import tempfile
import zipfile


def attach(spark) -> None:
    """Ships this package to the session's Python workers, once a session, where they were not started with it on their path."""
    context = spark.sparkContext
    if getattr(context, "_keepsake_attached", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="keepsake-"), "keepsake.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("keepsake", os.path.relpath(path, top)))
    context.addPyFile(target)
    context._keepsake_attached = True
