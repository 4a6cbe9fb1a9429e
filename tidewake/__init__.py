"""tidewake: Spark jobs for animal telemetry and river surveys, with a corpus-preparation subpackage."""
