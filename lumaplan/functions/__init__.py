"""Column expressions of the codec's arithmetic; all stay inside whole-stage code generation."""
