"""Readers and writers for captures, manifests, labels, style sheets and logs."""
