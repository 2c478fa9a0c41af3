"""Sources and sinks: source trees, diffs, the versioned store, generated corpora."""
