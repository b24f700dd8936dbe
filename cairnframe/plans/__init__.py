"""Multi-step plans: import, consolidation, the snapshot store."""
