"""Jobs composed of several operators: training, stacking, searches."""
