"""Physical-plan helpers: written intermediates, hot-key joins, distributed ranks."""
