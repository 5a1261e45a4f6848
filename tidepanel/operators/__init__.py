"""DataFrame operators: panels, running totals, evaluation, profiling."""
