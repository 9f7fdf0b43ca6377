"""What a run leaves as evidence: profiles, lineage, graphs, locks, bundles, amendments, formatting."""
