"""Where rows come from and where statements go."""
