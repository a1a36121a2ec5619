"""Domain presets: dataset pipelines, market questions and operations read models."""
