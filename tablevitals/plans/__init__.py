"""Rules over metric rows and the whole audit."""
