"""Where tables come from and where their snapshots go."""
