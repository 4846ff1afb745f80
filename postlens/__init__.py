"""postlens — Spark-native analytics over annotated social posts.

Every public operator is a function ``DataFrame -> DataFrame``; nothing is
collected to the driver, so Catalyst plans the work and the cluster runs it.
"""

from postlens.model import OTHER, NONE, SENTINELS, QuerySpec  # noqa: F401

__version__ = "0.1.0"
