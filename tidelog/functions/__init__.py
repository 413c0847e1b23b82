"""Column -> Column helpers; all of them stay inside the JVM unless a docstring says otherwise."""
