"""From text to semantic ranges: what a chunk may be cut along."""
