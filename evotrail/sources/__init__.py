"""Where logs, snapshots and state come from, and where notifications go."""
