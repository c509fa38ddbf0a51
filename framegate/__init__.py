"""framegate: Spark jobs for label boards, candidate ranking, rule cascades and mask evaluation."""
