"""Column functions: triple scores, fused scores, rewards and schedules."""
