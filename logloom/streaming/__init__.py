"""Growing files: change detection, a streaming source and incremental timelines."""
