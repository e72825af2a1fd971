"""Row-local and windowed steps on unbounded input."""
