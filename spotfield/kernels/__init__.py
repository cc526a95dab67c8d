"""Small NumPy helpers that run inside Spark tasks on bounded inputs."""
