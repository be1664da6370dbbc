"""Change-impact analytics over component graphs, expressed as DataFrame operators."""
