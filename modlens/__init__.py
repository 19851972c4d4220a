"""modlens: Spark-native analytics for labelled and machine-scored text moderation data.

Every operator is a function from DataFrame to DataFrame built on Spark's
DataFrame / SQL / ML APIs. Sampling is key-based (md5 of key and seed), so
results do not depend on partitioning and can be checked against plain SQL.
"""

from modlens.session import build_session, checkpoint_root, scratch_path

__all__ = ["build_session", "checkpoint_root", "scratch_path"]
