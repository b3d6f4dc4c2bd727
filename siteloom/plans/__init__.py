"""Multi-operator jobs: each is one lazy DataFrame plan."""
