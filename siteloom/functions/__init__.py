"""Column-to-Column scalar library; everything stays on the JVM unless a docstring says otherwise."""
